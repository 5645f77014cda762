"""N-gram Jaccard join: universe-partition pigeonhole with one-deletion neighbourhoods and exact verification.

A document's set is cut by hash into segments. Linked sets differ in at most ``H`` shingles, so with segments of
allowance e (0: equal, 1: equal but for one deletion) and sum(e + 1) = H + 1, some segment agrees within its
allowance. Size bands fix H; a set signs its own band and, if a larger set could still link with it, the next one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopath.llm.common import Bounded, chunks, components, drop_path, few, forget_shuffles, materialize, pack, shuffle_parts, texts

BAND_RATIO, EXPECTED_ROWS, SMALL_GROUP, GROUP_BLOCK = 1.4, 1e6, 8, 4096
#: Bytes of a bucket of signatures and of a block's sets; a member's likely pairs in the first round.
BUCKET_BYTES, BLOCK_BYTES, LIKELY = 8 << 20, 4 << 20, 256
U = np.uint64
_K = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * _K[3]
    x = (x ^ (x >> U(33))) * _K[4]
    return x ^ (x >> U(33))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(91).integers(-(1 << 63), 1 << 63, 256, dtype=np.int64).astype(U)


def word_hashes(buf: np.ndarray, blanks: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit hash) of the words of a buffer: bytes weighted by their place in the word, summed and mixed."""
    blank = blanks[buf]
    start = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    if not len(start):
        return start, np.empty(0, U)
    ends = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    at = np.arange(len(buf)) - np.repeat(start, np.diff(np.r_[start, len(buf)])) if not start[0] else np.arange(len(buf)) - np.r_[np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.r_[start, len(buf)]))]
    place = mix(np.arange(int((ends - start).max()) + 1, dtype=U) + _K[0]) | U(1)
    value = _BYTE[_LOWER[buf]] * place[np.minimum(at, len(place) - 1)]
    value[blank] = 0
    return start, mix(np.add.reduceat(value, start) + (ends - start).astype(U) * _K[1])


def shingle_sets(texts: list[str], width: int = 3) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    out = []
    for i, j in chunks(raw):
        edges = np.cumsum([0] + [len(r) + 1 for r in raw[i:j]])
        start, h = word_hashes(np.frombuffer(b"\n".join([*raw[i:j], b""]), np.uint8))
        first = np.searchsorted(start, edges)
        x = np.zeros(max(0, len(h) - width + 1), U)
        for k in range(width):
            x = mix(x + h[k : k + len(x)] * _K[k % 3])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                y = np.sort(x[a : b - width + 1])
                out.append(y[np.r_[True, y[1:] != y[:-1]]])
            elif b > a:  # the whole sequence is the one shingle
                one = np.full(1, b - a, U)
                for k in range(a, b):
                    one = mix(one * _K[2] + h[k])
                out.append(one)
            else:
                out.append(np.empty(0, U))
    return out


def max_difference(total: int, num: int, den: int) -> int:
    """Largest symmetric difference of two linked sets whose sizes add up to ``total``: total * (1-t)/(1+t)."""
    return total * (den - num) // (den + num)


@cache
def bands(limit: int) -> list[int]:
    """Smallest sizes of the bands up to a size."""
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * BAND_RATIO)))
    return out


@cache
def allocation(lo: int, hi: int, num: int, den: int) -> tuple[int, int, int]:
    """(one-deletion segments, exact segments, spare) of a band: the cheapest count of signatures plus chance meetings.

    Allowances cover H + 1 + spare differences, so linked sets agree in segments worth more than ``spare``. A set with
    at most ``spare`` empty exact segments leaves those unsigned: they can't be all that agrees.
    """
    need = max_difference(2 * hi, num, den) + 1
    if need == 1:
        return 0, 0, 0  # only equal sets can link, and they are one class already
    best = None
    for ones in range(0, min(need, 40) // 2 + 1 + need % 2):
        for spare in range(0, 24):
            exact = need + spare - 2 * ones
            if exact < 0:
                continue
            mean = lo / (ones + exact)
            empty = exact * math.exp(-mean)
            tail = 1 - sum(math.exp(-empty) * empty**k / math.factorial(k) for k in range(spare + 1))
            cost = exact + ones * (1 + mean) + EXPECTED_ROWS * (max(tail, 0.0) * math.exp(-mean) + ones * ((1 + mean) * math.exp(-mean)) ** 2)
            best = min(best or (cost, ones, exact, spare), (cost, ones, exact, spare))
    return best[1:]


def signatures(x: np.ndarray, num: int = 90, den: int = 100) -> np.ndarray:
    """Signatures of a set in the bands where it can meet a linked set."""
    n, out = len(x), []
    starts = bands(n * den // num * 2 + 2)
    own = int(np.searchsorted(starts, n, "right")) - 1
    places = np.minimum(mix(x + _K[1]) >> U(11), U((1 << 53) - 1)).astype(np.float64) / float(1 << 53)
    g = mix(x ^ _K[2])
    for b in range(own, len(starts) - 1):
        if b != own and den * n < num * starts[b]:
            break
        ones, exact, spare = allocation(starts[b], starts[b + 1] - 1, num, den)
        m = ones + exact
        if not m:
            continue
        seg = (places * m).astype(np.int64)
        total = np.zeros(m, U)
        np.add.at(total, seg, g)
        salt = mix(np.arange(m, dtype=U) + U((b * int(_K[0])) % (1 << 64)))
        signed = np.ones(m, bool)
        empty = np.flatnonzero(np.bincount(seg, minlength=m)[ones:] == 0) + ones
        if len(empty) <= spare:
            signed[empty] = False
        out.append(mix(total ^ salt)[signed])
        if ones:
            at = seg < ones
            out.append(mix((total[seg[at]] - g[at]) ^ salt[seg[at]]))
    return np.concatenate(out) if out else np.empty(0, U)


def parity(x: np.ndarray, least: int | None = None) -> bytes:
    """Parity of the number of shingles in each of 2^k bins: where two of these differ in more bins than H, so do the sets."""
    bins = 1 << max(6, ((least or 8 * (len(x) // 9 + 1)) - 1).bit_length())
    return np.packbits(np.bincount((x & U(bins - 1)).astype(np.int64), minlength=bins).astype(np.uint8) & 1).tobytes()


def _folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches as rows of 64-bit numbers, wider ones folded to ``width`` bytes: bins that agree modulo the width meet."""
    out = np.empty((len(sketches), width), np.uint8)
    for i, s in enumerate(sketches):
        v = np.frombuffer(s, np.uint8)
        out[i] = v if len(v) == width else np.bitwise_xor.reduce(v.reshape(-1, width), axis=0)
    return out.view(U)


def size_code(n: int) -> int:
    """A set's size in steps of a tenth, for a filter before the exact one: a byte beside each signature."""
    return min(255, int(math.log(n) * 10))


def digest(x: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a set, as two signed numbers: the first is its address, both together its identity."""
    h = xxhash.xxh3_128_intdigest(x.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _facts(width: int):
    """Size, digest and parities of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = shingle_sets(texts(b), width)
            d = [digest(v) if len(v) else (None, None) for v in x]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64()), "n_shingles": pa.array([len(v) for v in x], pa.int64()), "node": pa.array([v[0] for v in d], pa.int64()), "chk": pa.array([v[1] for v in d], pa.int64()), "mark": pa.array([parity(v) if len(v) else None for v in x], pa.binary())})

    return run


def _sign(width: int, num: int, den: int, buckets: int):
    """Packed signatures for each bucket. A second pass over the texts, so that signatures lie on disk once, as the
    shuffle's files, and not in a table as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Bounded(200_000)
        sigs, owners, lens, held = [], [], [], 0

        def out():
            s = np.concatenate(sigs)
            packed = list(pack((s % U(buckets)).astype(np.int32), [s, np.concatenate(owners), np.concatenate(lens)]))
            return pa.RecordBatch.from_pydict({"bucket": pa.array([p[0] for p in packed], pa.int32()), **{c: pa.array([p[1][i] for p in packed], pa.binary()) for i, c in enumerate(("sig", "who", "len"))}})

        for b in batches:
            for x in shingle_sets(texts(b), width):
                node = digest(x) if len(x) else None
                if node is None or node in seen:  # equal sets sign once a worker
                    continue
                seen.room(1)
                seen[node] = True
                s = signatures(x, num, den)
                if len(s):
                    sigs.append(s)
                    owners.append(np.full(len(s), node[0], np.int64))
                    lens.append(np.full(len(s), size_code(len(x)), np.uint8))
                    held += len(s)
            if held > 500_000:
                yield out()
                sigs, owners, lens, held = [], [], [], 0
        if sigs:
            yield out()

    return run


def _meet(num: int, den: int):
    """Candidate pairs of each bucket, rows sorted by bucket: all pairs of a small group; of a large one its pairs with
    its smallest node, and its members. One bucket is held at a time."""

    def bucket(sig: np.ndarray, who: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        # Only signatures that occur again matter; sorting those alone by node as well keeps this cheap.
        order = np.argsort(sig, kind="stable")
        s = sig[order]
        again = np.r_[False, s[1:] == s[:-1]]
        order = order[again | np.r_[again[1:], False]]
        order = order[np.lexsort((who[order], sig[order]))]
        sig, who, size = sig[order], who[order], size[order]
        fresh = np.r_[True, (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])] if len(sig) else np.zeros(0, bool)
        sig, who, size = sig[fresh], who[fresh], size[fresh]
        if not len(sig):
            return
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        count = np.diff(np.r_[first, len(sig)])
        grp = np.repeat(np.arange(len(first)), count)
        apart = math.ceil(math.log(den / num) * 10) + 1
        fits = lambda i, j: np.abs(size[i].astype(np.int64) - size[j]) <= apart
        left, right = [], []
        small = count <= SMALL_GROUP
        for d in range(1, SMALL_GROUP):
            i = np.flatnonzero(small[grp[:-d]] & (grp[:-d] == grp[d:])) if len(grp) > d else np.empty(0, int)
            i = i[fits(i, i + d)]
            left.append(who[i])
            right.append(who[i + d])
        big = np.flatnonzero(~small[grp])
        i, j = first[grp[big]], big
        ok = (i != j) & fits(i, j)
        left.append(who[i[ok]])
        right.append(who[j[ok]])
        pair = np.stack([np.concatenate(left), np.concatenate(right)], 1)
        if len(pair):
            pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
            pair = pair[np.r_[True, (pair[1:] != pair[:-1]).any(1)]]
        for kind, a, c in ((0, pair[:, 0], pair[:, 1]), (1, sig[big].view(np.int64), who[big])):
            for lo in range(0, len(a), 100_000):
                m = len(a[lo : lo + 100_000])
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(m, kind, np.int32)), "a": pa.array(a[lo : lo + 100_000]), "b": pa.array(c[lo : lo + 100_000])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [])

        def joined():
            return (np.concatenate(x) for x in held)

        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("bucket", "sig", "who", "len")), strict=True)
            for k, *cells in rows:
                if k != key:
                    if held[0]:
                        yield from bucket(*joined())
                    key, held = k, ([], [], [])
                for to, v, kind in zip(held, cells, (U, np.int64, np.uint8), strict=True):
                    to.append(np.frombuffer(v, kind))
        if held[0]:
            yield from bucket(*joined())

    return run


def _may_link(num: int, den: int):
    """Pairs that their parities don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb, keep = np.asarray(b.column("na")), np.asarray(b.column("nb")), []
            for i, (p, q) in enumerate(zip(b.column("ma").to_pylist(), b.column("mb").to_pylist(), strict=True)):
                x, y = _folded([p, q], min(len(p), len(q)))
                if int(np.bitwise_count(x ^ y).sum()) <= max_difference(int(na[i] + nb[i]), num, den):
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def forest(sets: list[np.ndarray], comp: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links between the components of some sets, verified, until the sets' links join no others: at most one for each
    set, whatever the number of pairs. Only pairs across components are compared."""
    size = np.array([len(x) for x in sets])
    _, lab = np.unique(comp, return_inverse=True)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    edge = np.r_[0, np.cumsum(size)]
    held, out = np.zeros(int(flat.max(initial=0)) + 1, bool), []
    for i in range(len(sets)):
        cand = np.flatnonzero((lab != lab[i]) & (den * np.minimum(size, size[i]) >= num * np.maximum(size, size[i])))
        cand = cand[cand > i]
        if not len(cand):
            continue
        mine = flat[edge[i] : edge[i + 1]]
        held[mine] = True
        for lo in range(0, len(cand), 512):
            c = cand[lo : lo + 512]
            c = c[lab[c] != lab[i]]
            if not len(c):
                continue
            at = np.concatenate([flat[edge[k] : edge[k + 1]] for k in c.tolist()])
            common = np.add.reduceat(held[at], np.r_[0, np.cumsum(size[c])[:-1]], dtype=np.int64)
            linked = c[den * common >= num * (size[i] + size[c] - common)]
            _, first = np.unique(lab[linked], return_index=True)
            out += [(i, int(k)) for k in linked[first]]
            lab[np.isin(lab, lab[linked])] = lab[i]
        held[mine] = False
    return out


def _tied(num: int, den: int):
    """Links between components in blocks of large groups, at most one for each member; rows sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, g = None, {}

        def done():
            pairs = forest([np.frombuffer(x, U) for x in g["hashes"]], np.array(g["comp"]), num, den)
            return pa.RecordBatch.from_pydict({"a": pa.array([g["rep"][i] for i, _ in pairs], pa.int64()), "b": pa.array([g["rep"][j] for _, j in pairs], pa.int64())})

        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in ("rep", "comp", "hashes")}
            for r, k in enumerate(zip(*(b.column(c).to_pylist() for c in ("top", "blk")), strict=True)):
                if k != key:
                    if g:
                        yield done()
                    key, g = k, {c: [] for c in cols}
                for c, v in cols.items():
                    g[c].append(v[r])
        if g:
            yield done()

    return run


def _sharp(num: int, den: int):
    """Wider parities for members of large groups: pairs that these don't rule out are nearly all linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.frombuffer(v, U) for v in b.column("hashes").to_pylist()]
            yield pa.RecordBatch.from_pydict({"node": b.column("node"), "rep": b.column("rep"), "size": pa.array([len(v) for v in x], pa.int32()), "sharp": pa.array([parity(v, 16 * (max_difference(2 * len(v), num, den) + 1)) for v in x], pa.binary())})

    return run


def _blocks(batches: Iterator[pa.RecordBatch], columns: tuple) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Rows sorted by (top, i, j), one block at a time."""
    key, g = None, {}
    for b in batches:
        cols = {c: b.column(c).to_pylist() for c in columns}
        ks = np.stack([np.asarray(b.column(c), dtype=np.int64) for c in ("top", "i", "j")], 1)
        cuts = np.flatnonzero(np.r_[True, (ks[1:] != ks[:-1]).any(1), True]) if len(ks) else []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            k = tuple(ks[s].tolist())
            if k != key:
                if g:
                    yield key, g
                key, g = k, {c: [] for c in cols}
            for c, v in cols.items():
                g[c] += v[s:e]
    if g:
        yield key, g


def _alive(num: int, den: int):
    """Members of a block that sizes and parities leave any partner in another component: chance meetings end here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, nodes = [], []

        def out():
            return pa.RecordBatch.from_pydict({"top": pa.array(np.concatenate(tops), pa.int64()), "node": pa.array(np.concatenate(nodes), pa.int64())})

        for (top, i, j), g in _blocks(batches, ("node", "size", "mark", "comp", "blk")):
            node, comp, size, blk = (np.array(g[c]) for c in ("node", "comp", "size", "blk"))
            mark = _folded(g["mark"], min(map(len, g["mark"])))
            alive = np.zeros(len(node), bool)
            step = max(1, (1 << 20) // (len(node) * mark.shape[1]))
            for a in range(0, len(node), step):
                r = slice(a, a + step)
                ok = (comp[r, None] != comp) & (den * np.minimum(size[r, None], size) >= num * np.maximum(size[r, None], size))
                if i != j:
                    ok &= blk[r, None] != blk
                ok &= np.bitwise_count(mark[r, None] ^ mark[None]).sum(2, dtype=np.int64) <= (size[r, None] + size) * (den - num) // (den + num)
                alive[r] |= ok.any(1)
            if alive.any():
                nodes.append(node[alive])
                tops.append(np.full(len(nodes[-1]), top))
            if len(nodes) >= 1000:
                yield out()
                tops, nodes = [], []
        if nodes:
            yield out()

    return run


def _cross(num: int, den: int, most: int):
    """Pairs across components among the members of all groups about one class, block against block, that sizes and
    parities don't rule out.

    Of each member that is not of its block's largest component the ``most`` likeliest pairs, and a row (null, null)
    where that left some out.
    """

    def pairs(g: dict, same_block: bool) -> tuple[np.ndarray, bool]:
        node, comp, size, blk = (np.array(g[c]) for c in ("node", "comp", "size", "blk"))
        mark = _folded(g["sharp"], min(map(len, g["sharp"])))
        _, lab, many = np.unique(comp, return_inverse=True, return_counts=True)
        weight = many[lab]
        out, cut = [], False
        for i in np.flatnonzero(weight < weight.max()) if (weight < weight.max()).any() else range(len(node)):
            # Each pair counts from the side of the smaller component, of equal ones from the smaller node's side.
            ok = (comp != comp[i]) & ((weight > weight[i]) | ((weight == weight[i]) & (node > node[i])))
            ok &= den * np.minimum(size[i], size) >= num * np.maximum(size[i], size)
            if not same_block:
                ok &= blk != blk[i]
            q = np.flatnonzero(ok)
            if not len(q):
                continue
            differ = np.bitwise_count(mark[q] ^ mark[i]).sum(1, dtype=np.int64)
            near = differ <= (size[i] + size[q]) * (den - num) // (den + num)
            q, differ = q[near], differ[near]
            if len(q) > most:
                cut = True
                q = q[np.lexsort((node[q], differ))[:most]]
            out.append(np.stack([np.full(len(q), node[i]), node[q]], 1))
        return (np.concatenate(out) if out else np.empty((0, 2), np.int64)), cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Bounded(300_000)
        for key, g in _blocks(batches, ("node", "comp", "size", "sharp", "blk")):
            p, cut = pairs(g, key[1] == key[2])
            new = [t for t in map(tuple, np.sort(p, axis=1).tolist()) if t not in seen]
            seen.room(len(new))
            seen.update(dict.fromkeys(new))
            if new or cut:
                a, b = ([t[k] for t in new] + [None] * cut for k in (0, 1))
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _sets(width: int):
    """Sets of the documents that stand for their sets; a row of the same doc_id with another text is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = shingle_sets(texts(b), width)
            want = list(zip(b.column("node").to_pylist(), b.column("chk").to_pylist(), strict=True))
            keep = [i for i, v in enumerate(x) if len(v) and digest(v) == want[i]]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_pydict({"node": b.column("node").take(at), "chk": b.column("chk").take(at), "rep": b.column("doc_id").cast(pa.int64()).take(at), "hashes": pa.array([x[i].tobytes() for i in keep], pa.binary())})

    return run


def _exact(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ra, rb, ok = b.column("ra").to_pylist(), b.column("rb").to_pylist(), []
            for p, q in zip(b.column("ha"), b.column("hb"), strict=True):
                x, y = np.frombuffer(p.as_buffer(), U), np.frombuffer(q.as_buffer(), U)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(den * common >= num * (len(x) + len(y) - common))
            keep = [i for i, o in enumerate(ok) if o]
            yield pa.RecordBatch.from_pydict({"a": pa.array([ra[i] for i in keep], pa.int64()), "b": pa.array([rb[i] for i in keep], pa.int64())})

    return run


class _Classes:
    """Links found so far and the components that they make; old tables go as soon as new ones stand."""

    def __init__(self, spark):
        self.spark, self.links, self.paths = spark, None, []
        self.comp, self.at = None, None

    def add(self, links: DataFrame, path: str) -> None:
        self.paths.append(path)
        self.links = links if self.links is None else self.links.union(links)
        old = self.at
        self.comp, self.at = components(self.links)
        if old:
            drop_path(self.spark, old)
        forget_shuffles(self.spark)

    def of(self, rows: DataFrame, rep: str, name: str) -> DataFrame:
        """``rows`` with the component of their column ``rep``."""
        return rows.join(self.comp.select(F.col("node").alias(rep), F.col("component").alias("_c")), rep, "left").withColumn(name, F.coalesce("_c", rep)).drop("_c")


def jaccard_classes(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Classes of documents linked by shingle sets with ``den * |A and B| >= num * |A or B|``.

    ``docs(doc_id, text)``, other columns ignored; rows ``(doc_id, n_shingles, component_id)``, one per input row,
    component_id the smallest doc_id reachable by links, itself included. Words are runs outside ASCII white space,
    A-Z lower-cased; with fewer words than ``width`` the whole sequence is the one shingle; null, empty or blank texts
    have no shingles and link with nothing. A null doc_id keeps its row; its set counts where another row with a doc_id
    has the same set, and else links with nothing (component_id null). Rows that share a doc_id are one document.
    Documents with equal sets are one class, signed once. Pairs are verified where they can still join two classes:
    first one pair of each set, then what is left across classes. Members of large signature groups are tied to their
    group's smallest one, then to each other inside blocks, and what stays apart meets in pairs of blocks, a few likely
    pairs of each member at a time until none is left, so near copies cost no all-pairs output.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = shuffle_parts(spark)
    facts, facts_path = materialize(src.mapInArrow(_facts(width), "doc_id long, n_shingles long, node long, chk long, mark binary"), "ngram-facts")
    total = facts.agg(F.sum("n_shingles")).first()[0] or 0
    nodes, nodes_path = materialize(facts.where("node is not null").groupBy("node", "chk").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("mark").alias("mark")), "ngram-nodes")
    # About a signature and a half for each difference that is allowed, 17 bytes each; buckets of some megabytes.
    buckets = max(parts * 4, total * (den - num) // den * 25 // BUCKET_BYTES + 1)
    packed = src.mapInArrow(_sign(width, num, den, buckets), "bucket int, sig binary, who binary, len binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    met, met_path = materialize(packed.mapInArrow(_meet(num, den), "kind int, a long, b long"), "ngram-met")
    del packed
    one, two = (nodes.select(F.col("node").alias(k), F.col("n").alias("n" + k), F.col("mark").alias("m" + k)) for k in "ab")
    pairs = met.where("kind = 0").select("a", "b").distinct()
    t = few(met.count(), 10_000)
    likely, likely_path = materialize(pairs.join(one, "a").coalesce(t).join(two, "b").coalesce(t).select("a", "b", "na", "nb", "ma", "mb").mapInArrow(_may_link(num, den), "a long, b long").distinct(), "ngram-likely", t)
    t = few(likely.count(), 2_000)  # tasks of what follows, which compares pairs
    large = met.where("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("node"))
    del pairs
    forget_shuffles(spark)
    # The sets of all that may still be compared, from one more pass over their texts.
    need = likely.select(F.col("a").alias("node")).union(likely.select("b")).union(large.select("node")).distinct().join(nodes, "node").where("rep is not null").select(F.col("rep").alias("doc_id"), "node", "chk")
    sets = src.join(need, "doc_id").select("doc_id", "text", "node", "chk").mapInArrow(_sets(width), "node long, chk long, rep long, hashes binary")
    if facts.groupBy("doc_id").count().where("doc_id is not null and count > 1").limit(1).count():  # else none comes twice
        sets = sets.dropDuplicates(["node", "chk"])
    sets, sets_path = materialize(sets, "ngram-sets")
    forget_shuffles(spark)

    def verified(pairs: DataFrame, t: int) -> tuple[DataFrame, str]:
        one, two = (sets.select(F.col("node").alias(k), F.col("rep").alias("r" + k), F.col("hashes").alias("h" + k)) for k in "ab")
        return materialize(pairs.join(one, "a").coalesce(t).join(two, "b").coalesce(t).select("ra", "rb", "ha", "hb").mapInArrow(_exact(num, den), "a long, b long").distinct(), "ngram-links", t)

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs of nodes that are in different classes as yet."""
        reps = nodes.where("rep is not null").select("node", "rep")
        for k in "ab":
            pairs = classes.of(pairs.join(reps.withColumnsRenamed({"node": k, "rep": "r" + k}), k).coalesce(t), "r" + k, "c" + k).coalesce(t)
        return pairs.where("ca <> cb").select("a", "b").distinct()

    classes = _Classes(spark)
    classes.add(*verified(likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), t))
    rest, rest_path = materialize(apart(likely), "ngram-rest", t)
    drop_path(spark, likely_path)
    forget_shuffles(spark)
    if rest.limit(1).count():
        classes.add(*verified(rest, t))
    drop_path(spark, rest_path)
    forget_shuffles(spark)

    if large.limit(1).count():

        def dealt(rows: DataFrame) -> DataFrame:
            """Rows in pairs of blocks (i, j) of their class's members, each pair of blocks together."""
            blocks = rows.groupBy("top").agg(F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias("nb"))
            out = rows.join(blocks, "top").withColumn("blk", F.expr("cast(pmod(xxhash64(node), nb) as int)"))
            out = out.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)"))).withColumn("i", F.least("blk", "other")).withColumn("j", F.greatest("blk", "other"))
            return out.drop("rep", "nb", "other").repartition("top", "i", "j").sortWithinPartitions("top", "i", "j")

        # Groups that hold several classes, by their largest class: those about one class hold nearly the same members,
        # which meet once for all of them. Narrow parities end all meetings by chance.
        facts_of = nodes.where("rep is not null").select("node", "rep", F.col("n").cast("int").alias("size"))
        t = few(large.count(), 20_000)
        placed = classes.of(large.join(facts_of, "node").coalesce(t), "rep", "comp").coalesce(t)
        held = placed.groupBy("sig", "comp").agg(F.count("*").alias("n"))
        several = held.groupBy("sig").agg(F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("k")).where("k > 1").select("sig", F.col("m.comp").alias("top"))
        about, about_path = materialize(placed.join(several, "sig").select("top", "node", "rep", "size", "comp").coalesce(t).distinct(), "ngram-about", t)
        forget_shuffles(spark)
        narrow = dealt(about.join(nodes.select("node", "rep", "mark"), ["node", "rep"]))
        alive, alive_path = materialize(narrow.mapInArrow(_alive(num, den), "top long, node long").distinct().coalesce(t).join(facts_of, "node"), "ngram-alive", t)
        drop_path(spark, about_path, met_path)
        forget_shuffles(spark)
        members, members_path = materialize(alive.select("node").distinct().join(sets, "node").mapInArrow(_sharp(num, den), "node long, rep long, size int, sharp binary").repartition("node"), "ngram-members")

        def apart_still() -> DataFrame:
            """Members (top, node, rep, size, comp) about a class that are not all of one class yet."""
            now = classes.of(alive, "rep", "comp").coalesce(t)
            mixed = now.groupBy("top").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("top").coalesce(t)
            return now.join(mixed, "top").coalesce(t)

        # Every member goes once to one of these, and there into one block of bounded size.
        now = apart_still()
        sizes = now.groupBy("top").agg(F.count("*").alias("g"), F.sum("size").alias("all"))
        chosen = now.join(sizes, "top").groupBy("node", "rep", "comp").agg(F.max(F.struct("g", "top", "all")).alias("m"))
        chosen = chosen.select("node", "rep", "comp", "m.top", F.expr(f"cast(pmod(xxhash64(node), ceil(m.all * 8 / {BLOCK_BYTES})) as int)").alias("blk"))
        own = chosen.join(sets.select("node", "rep", "hashes"), ["node", "rep"]).select("top", "blk", "rep", "comp", "hashes").repartition("top", "blk").sortWithinPartitions("top", "blk")
        classes.add(*materialize(own.mapInArrow(_tied(num, den), "a long, b long").distinct(), "ngram-links", t))
        most, again = LIKELY, True
        while again:
            wide = dealt(apart_still().join(members.select("node", "rep", "sharp"), ["node", "rep"]))
            found, found_path = materialize(wide.mapInArrow(_cross(num, den, most), "a long, b long").distinct(), "ngram-found", t)
            forget_shuffles(spark)
            some = found.where("a is not null")
            if some.limit(1).count():
                classes.add(*verified(some, few(found.count(), 2_000)))
            again = found.where("a is null").limit(1).count() > 0
            drop_path(spark, found_path)
            most *= 8
        drop_path(spark, alive_path, members_path)
    reps = classes.of(nodes.where("rep is not null").select("node", "chk", "rep"), "rep", "component_id").drop("rep")
    out = facts.join(reps, ["node", "chk"], "left")
    out, _ = materialize(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "ngram-classes")
    drop_path(spark, facts_path, nodes_path, sets_path, met_path, classes.at, *classes.paths)
    return out


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
