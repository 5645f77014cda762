"""Suffix order with common-prefix lengths by external induced sorting.

Suffixes are typed L or S; the left-most S suffixes are put in order first (names of their substrings, then pairs of
names, level by level), and everything else is induced from them: one scan of the symbol buckets upwards yields the L
suffixes, one downwards the S suffixes. Each bucket is a queue of (position, common prefix) tuples in arrival order,
which is priority order; queues beyond ``memory`` bytes go to an unnamed scratch file that ends with the task. The
common prefix of two induced neighbours is one more than the least of those between the suffixes that induced them.
Lengths are capped at ``cap`` (at most 255): order and lengths are exact as far as ``cap`` symbols.
"""

from __future__ import annotations

import tempfile

import numpy as np

END = 0xFF  # never occurs in UTF-8; stands between texts


class Queues:
    """A first-in first-out queue of (position, prefix) chunks for each symbol, in memory up to a bound, then on disk."""

    def __init__(self, memory: int):
        self.chunks: list[list] = [[] for _ in range(256)]
        self.memory, self.held, self.file = memory, 0, None

    def put(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        if self.held + pos.nbytes + lcp.nbytes > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            pos.tofile(self.file)
            lcp.tofile(self.file)
            self.chunks[symbol].append((at, len(pos)))
        else:
            self.held += pos.nbytes + lcp.nbytes
            self.chunks[symbol].append((pos, lcp))

    def filled(self, symbol: int) -> bool:
        return bool(self.chunks[symbol])

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        ps, ls = [np.empty(0, np.int32)], [np.empty(0, np.uint8)]
        for a, b in self.chunks[symbol]:
            if isinstance(a, np.ndarray):
                self.held -= a.nbytes + b.nbytes
            else:
                self.file.seek(a)
                a, b = np.fromfile(self.file, np.int32, b), np.fromfile(self.file, np.uint8, b)
            ps.append(a)
            ls.append(b)
        self.chunks[symbol] = []
        return np.concatenate(ps), np.concatenate(ls)


def range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo..hi], lo <= hi, by doubling tables; queries are answered at the level of their length."""
    out = np.empty(len(lo), values.dtype)
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    order = np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[order], np.arange(int(level.max(initial=0)) + 2))
    table = values
    for k in range(len(bounds) - 1):
        q = order[bounds[k] : bounds[k + 1]]
        if len(q):
            out[q] = np.minimum(table[lo[q]], table[hi[q] - (1 << k) + 1])
        if k + 2 < len(bounds):
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one big-endian number each (a view)."""
    return np.lib.stride_tricks.as_strided(text[:8].view(">u8"), (len(text) - 7,), (1,))


def extend(words: np.ndarray, p: np.ndarray, q: np.ndarray, done: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix lengths, at most ``cap``, of the suffixes p and q that agree in ``done`` symbols."""
    out = np.minimum(done.astype(np.int64), cap)
    live = np.flatnonzero(out < cap)
    top = len(words) - 1
    while len(live):
        a, b = p[live] + out[live], q[live] + out[live]
        ok = (a <= top) & (b <= top)
        x = np.where(ok, words[np.minimum(a, top)] ^ words[np.minimum(b, top)], np.uint64(1 << 63)).astype(np.uint64)
        eq = 8 - (np.frexp((x >> np.uint64(1)).astype(np.float64) * 2 + (x & np.uint64(1)).astype(np.float64))[1] + 7) // 8
        # A float may round up to the next power of two only within one byte's top bit; such cases are settled below.
        high = np.clip(eq, 0, 7)
        byte = (x >> ((np.uint64(7) - high.astype(np.uint64)) * np.uint64(8))) & np.uint64(255)
        eq = np.where(x == 0, 8, np.where(byte == 0, high + 1, high))
        out[live] += eq
        live = live[(eq == 8) & (out[live] < cap)]
    return np.minimum(out, cap)


def order_seeds(text: np.ndarray, words: np.ndarray, seeds: np.ndarray, n: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Left-most S suffixes in order, with common prefixes: names of substrings, then recursively names of pairs."""
    m = len(seeds)
    length = np.diff(np.r_[seeds, n - 1]) + 1
    # Substrings by eight symbols a round; a shorter one that begins a longer one comes after it (S after L).
    rank = np.zeros(m, np.int64)
    live, off = np.arange(m), 0
    while len(live):
        left = length[live] - off
        at = np.minimum(seeds[live] + off, len(words) - 1)
        w = words[at].astype(np.uint64)
        short = left < 8
        # Symbols behind the end count as the largest symbol; at equal words the shorter substring is the larger.
        fill = np.where(short, np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.clip(left, 0, 7).astype(np.uint64) * np.uint64(8)), np.uint64(0))
        last = short & (live == m - 1)  # ends with the text, whose end is smaller than every symbol
        w = np.where(last, w & ~fill, w | fill)
        tie = np.where(last, -1, np.where(short, 8 - left, 0))
        if off:
            o = np.lexsort((tie, w, rank[live]))
        else:  # ties at equal words are rare: symbols of an end inside a substring
            o = np.argsort(w)
            a = w[o]
            same = a[1:] == a[:-1]
            if (same & (tie[o][1:] != tie[o][:-1])).any():
                at = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
                o[at] = o[at][np.lexsort((tie[o[at]], a[at]))]
        r, w, s = rank[live][o], w[o], tie[o]
        new = np.r_[True, (r[1:] != r[:-1]) | (w[1:] != w[:-1]) | (s[1:] != s[:-1])]
        first = np.r_[True, r[1:] != r[:-1]]
        base = np.maximum.accumulate(np.where(first, np.arange(len(o)), 0))
        start = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
        ranks = np.empty(len(o), np.int64)
        ranks[o] = r + (start - base)  # ranks leave room for the size of their group
        rank[live] = ranks
        cuts = np.flatnonzero(np.r_[new, True])
        many = np.zeros(len(o), bool)
        many[o] = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
        live = live[many & ~short]
        off += 8
    levels, step = [rank.astype(np.int32)], 1
    order = np.argsort(rank, kind="stable")
    while step * 2 <= cap:
        r = rank[order]
        same = r[1:] == r[:-1]
        places = np.flatnonzero(np.r_[same, False] | np.r_[False, same]) if m > 1 else order[:0]
        if not len(places):
            break
        tied = order[places]
        after = np.minimum(tied + step, m)
        second = np.r_[rank, -1][after]
        o = np.argsort(rank[tied] * np.int64(m + 1) + second + 1)
        t = tied[o]
        a, b = rank[t], second[o]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        first = np.r_[True, a[1:] != a[:-1]]
        base = np.maximum.accumulate(np.where(first, np.arange(len(t)), 0))
        start = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
        rank = rank.copy()
        rank[t] = a + (start - base)
        levels.append(rank.astype(np.int32))
        step *= 2
        order[places] = t  # a rank is its group's first place in the order
    p, q = order[:-1].copy(), order[1:].copy()
    done = np.zeros(len(p), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        lv = levels[k]
        ok = (p < m) & (q < m)
        same = np.zeros(len(p), bool)
        same[ok] = lv[p[ok]] == lv[q[ok]]
        # Equal names agree in all but the shared last symbol of their substrings.
        p, q = np.where(same, np.minimum(p + (1 << k), m), p), np.where(same, np.minimum(q + (1 << k), m), q)
    ends = np.r_[seeds, n - 1]
    done = np.minimum(ends[np.minimum(p, m)] - seeds[order[:-1]], ends[np.minimum(q, m)] - seeds[order[1:]])
    lcp = np.r_[0, extend(words, seeds[order[:-1]], seeds[order[1:]], np.maximum(done, 0), cap)] if m else np.empty(0)
    return seeds[order].astype(np.int32), lcp.astype(np.uint8)


def _induce(text, words, cap, up, seeds, memory):
    """One scan. ``seeds(c)``: a bucket's suffixes that are known beforehand. Yields (symbol, positions, prefixes).

    Upwards, a bucket's new suffixes stand before its seeds and induce larger or equal symbols; downwards they stand
    before its seeds too, as seen from the top, and induce smaller or equal ones. Prefixes are with the suffix before.
    """
    q = Queues(memory)
    n = len(text) - 8
    if up:
        q.put(int(text[n - 1]), np.array([n - 1], np.int32), np.zeros(1, np.uint8))
    for c in range(256) if up else range(255, -1, -1):
        parts_p, parts_l = [], []
        pos, lcp = q.take(c)
        depth = 1
        while len(pos):
            parts_p.append(pos)
            parts_l.append(lcp)
            hit = np.flatnonzero((pos > 0) & (text[pos - 1] == c))
            if not len(hit):
                break
            nxt = np.full(len(hit), min(depth, cap), np.uint8)
            if len(hit) > 1:
                nxt[1:] = np.minimum(range_min(lcp, hit[:-1] + 1, hit[1:]).astype(np.int64) + 1, cap)
            pos, lcp, depth = (pos[hit] - 1).astype(np.int32), nxt, depth + 1
        own_p = np.concatenate(parts_p) if parts_p else np.empty(0, np.int32)
        own_l = np.concatenate(parts_l) if parts_l else np.empty(0, np.uint8)
        seed_p, seed_l = seeds(c)
        all_p, all_l = np.concatenate([own_p, seed_p]), np.concatenate([own_l, seed_l])
        if len(all_l):
            all_l[0] = 0
        if len(own_p) and len(seed_p):
            all_l[len(own_p)] = extend(words, own_p[-1:].astype(np.int64), seed_p[:1].astype(np.int64), np.ones(1, np.int64), cap)[0]
        own_l = all_l[: len(own_p)]
        yield c, own_p, own_l
        before = text[np.maximum(all_p - 1, 0)]
        at = np.flatnonzero((all_p > 0) & ((before > c) if up else (before < c)))
        if not len(at):
            continue
        o = at[np.argsort(before[at], kind="stable")]
        sym = before[o]
        cuts = np.flatnonzero(np.r_[True, sym[1:] != sym[:-1]])
        got = np.ones(len(o), np.uint8)
        inner = np.ones(len(o), bool)
        inner[cuts] = False
        k = np.flatnonzero(inner)
        if len(k):
            got[k] = np.minimum(range_min(all_l, o[k - 1] + 1, o[k]).astype(np.int64) + 1, cap)
        for a, b in zip(cuts, np.r_[cuts[1:], len(o)], strict=True):
            q.put(int(sym[a]), (all_p[o[a:b]] - 1).astype(np.int32), got[a:b])


def suffix_order(data: bytes, cap: int = 200, memory: int = 256 << 20):
    """Yield the suffixes of ``data`` in order, one symbol at a time: (positions, common prefixes with the one before).

    The end of the data counts as smaller than every symbol. Empty data give nothing; equal suffixes (as far as
    ``cap`` symbols) may come in any order.
    """
    n = len(data)
    if not n:
        return
    assert cap <= 255 and n < 1 << 31
    text = np.frombuffer(data + bytes([END] * 8), np.uint8)
    words = _words(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:n].astype(np.int16) - text[: n - 1].astype(np.int16))
    step[-1] = -1
    known = np.flatnonzero(step)
    small = step[known[np.searchsorted(known, np.arange(n))]] > 0  # S types: runs take the type of what ends them
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    seeds, seeds_l = order_seeds(text, words, lms, n, cap)
    first = text[seeds]
    bound = np.searchsorted(first, np.arange(257))
    scratch = Queues(memory)
    none = np.empty(0, np.int32), np.empty(0, np.uint8)

    def from_lms(c):
        return seeds[bound[c] : bound[c + 1]], seeds_l[bound[c] : bound[c + 1]]

    for c, pos, lcp in _induce(text, words, cap, True, from_lms, memory):
        if len(pos):
            scratch.put(c, pos, lcp)
    later: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def from_l(c):
        pos, lcp = scratch.take(c)
        later[c] = pos, lcp
        return (pos[::-1], np.r_[np.uint8(0), lcp[:0:-1]].astype(np.uint8)) if len(pos) else none

    for c, pos, lcp in _induce(text, words, cap, False, from_l, memory):
        lp, ll = later.pop(c)
        sp, sl = pos[::-1], np.r_[np.uint8(0), lcp[:0:-1]].astype(np.uint8) if len(pos) else none[1]
        if len(lp) and len(sp):
            sl[0] = extend(words, lp[-1:].astype(np.int64), sp[:1].astype(np.int64), np.ones(1, np.int64), cap)[0]
        if len(lp) + len(sp):
            yield np.concatenate([lp, sp]), np.concatenate([ll, sl])
