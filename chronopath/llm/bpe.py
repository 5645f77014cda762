"""Byte-pair encoding with word ends over distinct words, exactly as the tokenizers library encodes.

Two coders of a word share the reading of the tokenizer file and of the texts:

* ``count_symbols``: rank-synchronous merging. Batched words are one ragged array; every round merges each word's
  lowest-ranked pair at once, and what is left is counted.
* ``speculate``: longest match proposes tokens, a vectorised check tests every adjacent pair, and only words with a
  pair that merging would not leave standing are merged exactly.

Texts are cut at white space first, since no pre-token crosses it; a worker remembers the words it has met, in a
bounded memo.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from chronopath.llm.common import CHUNK, chunks, small_batches, texts

NEVER = 1 << 40
#: White space of Unicode; str.split() also splits at \x1c-\x1f, which are ordinary characters to the tokenizer.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]")
MEMO = 64 << 20  # bytes, about, of each of a memo's two generations
LONG = 64  # symbols of a block of a long word
_COST = 260  # of an entry, beside its key's characters
_ENDS = frozenset(".,!?;:")


class Memo:
    """Values of words in two generations: when the young one is full it becomes the old one, and the old one goes.

    A word that is met again moves to the young generation, so common words stay however many rare ones pass.
    """

    def __init__(self, limit: int = MEMO):
        self.limit, self.young, self.old, self.held = limit, {}, {}, 0

    def missing(self, words: set[str]) -> list[str]:
        """Words without a value; those of the old generation move to the young one."""
        if self.held > self.limit:
            self.young, self.old, self.held = {}, self.young, 0
        new, old = [], self.old
        for w in words - self.young.keys():
            v = old.get(w)
            if v is None:
                new.append(w)
            else:
                self.young[w] = v
                self.held += _COST + len(w)
        return new

    def put(self, values: dict, size: int) -> None:
        self.young.update(values)
        self.held += size + _COST * len(values)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


class Pairs:
    """(left, right) -> (rank, merged) in an open hash table of arrays; the few keys whose slot is taken are kept sorted."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, size: int = 20):
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.shift = np.uint64(64 - size)
        slot = self._slot(key)
        _, first = np.unique(slot, return_index=True)
        self.keys = np.full(1 << size, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.value = np.full(1 << size, -1, np.int64)
        self.keys[slot[first]], self.value[slot[first]] = key[first], first
        rest = np.setdiff1d(np.arange(len(key)), first)
        rest = rest[np.argsort(key[rest])]
        self.more_keys, self.more = np.r_[key[rest], np.uint64(0xFFFFFFFFFFFFFFFF)], np.r_[rest, -1]
        self.crowded = np.zeros(1 << size, bool)
        self.crowded[slot[rest]] = True
        self.merged = np.r_[merged, -1]

    def _slot(self, key):
        return ((key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NEVER where the pair doesn't merge."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.value[slot], NEVER)
        late = np.flatnonzero((out == NEVER) & self.crowded[slot])
        if len(late):
            at = np.searchsorted(self.more_keys, key[late])
            out[late] = np.where(self.more_keys[at] == key[late], self.more[at], NEVER)
        return out


# What a file must say of its texts and pre-tokens, for this coder to be exact.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}


class WordBPE:
    """Coder of a file of this kind: NFC, lower case, blanks dropped, byte symbols, word ends. Others are refused."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        for key, want, got in (("normalizer", NORMALIZER, spec["normalizer"]), ("pre_tokenizer", PRE_TOKENIZER, spec["pre_tokenizer"]), ("model", MODEL, {k: model.get(k) for k in MODEL}), ("decoder", None, spec["decoder"])):
            if got != want:
                raise ValueError(f"{path}: its {key} is not that of a word BPE file with lower case and word ends")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or "<" not in t["content"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: its added_tokens are not plain special strings in angle brackets")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.library = Tokenizer.from_file(path)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.text = {i: t for t, i in {**self.vocab, **self.specials}.items()}
        pair = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([self.vocab[p[i]] for p in pair], np.int64) for i in (0, 1))
        merged = np.array([self.vocab[a + b] for a, b in pair], np.int64)
        self.pairs = Pairs(left, right, merged)
        n = max(self.text) + 1
        # How each token was made: rank of its merge (-1: a base symbol), left part, right part.
        self.made, self.lo, self.hi = np.full(n, -1, np.int64), np.arange(n), np.arange(n)
        self.made[merged[::-1]], self.lo[merged[::-1]], self.hi[merged[::-1]] = np.arange(len(merged))[::-1], left[::-1], right[::-1]
        self.length = np.ones(n, np.int64)  # base symbols of each token
        for t, i in self.vocab.items():
            self.length[i] = len(t.removesuffix(self.suffix)) or 1
        self.chars = byte_characters()
        self.table = {i: c for i, c in enumerate(self.chars)}
        self.inner = np.array([self.vocab[c] for c in self.chars], np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in self.chars], np.int64)
        # Tokens that end a word, without their suffix, and how far tokens reach that begin with two characters.
        self.ended = {t[: len(t) - len(self.suffix)]: i for t, i in self.vocab.items() if t.endswith(self.suffix) and len(t) > len(self.suffix)}
        self.reach: dict[str, int] = {}
        for t in self.vocab:
            if not (self.suffix and t.endswith(self.suffix)):
                self.reach[t[:2]] = max(self.reach.get(t[:2], 0), len(t))
        self.longest_end = max(map(len, self.ended))
        self.split = regex.compile(PATTERN)

    def words(self, text: str) -> list[str]:
        if _ODD.search(text):
            return [w for w in _SPACE.split(text) if w]
        return text.split()

    def pretokens(self, word: str) -> list[str | int]:
        """Pre-tokens of a word without white space, in byte characters; special tokens as ids."""
        # Below U+0250 nothing composes, and letters alone, or with one stop behind, are plain pre-tokens.
        if word.isascii():
            if word.isalpha():
                return [word.lower()]
            if word[-1] in _ENDS and word[:-1].isalpha():
                return [word[:-1].lower(), word[-1]]
        elif max(word) < "ɐ":
            low = word.lower()  # may bring in a mark (U+0130), which is no letter
            if low.isalpha():
                return [self.bytes_of(low)]
            if low[-1] in _ENDS and low[:-1].isalpha():
                return [self.bytes_of(low[:-1]), low[-1]]
        out: list[str | int] = []
        for p in self.special.split(word) if self.special and "<" in word else [word]:
            if p in self.specials:
                out.append(self.specials[p])
            elif p and max(p) < "ɐ":
                out += [x.encode().decode("latin-1").translate(self.table) for x in self.split.findall(p.lower())]
            elif p:  # other scripts: the library's own tables
                out += [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(p))]
        return out

    def bytes_of(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.table)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Base symbols of words in byte characters, with each symbol's word."""
        back = self._back()
        flat = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16)
        size = np.fromiter(map(len, words), np.int64, len(words))
        byte = back[flat]
        sym = self.inner[byte]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[byte[ends]]
        return sym, np.repeat(np.arange(len(words)), size)

    def _back(self):
        if not hasattr(self, "back"):
            self.back = np.zeros(1024, np.int64)
            for i, c in enumerate(self.chars):
                self.back[ord(c)] = i
        return self.back

    def merge(self, sym: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merge all sequences together, one rank of each a round, in place; yield (symbols, sequences) of those that are done."""
        while len(sym):
            joined = own[1:] == own[:-1]
            rank = np.full(len(sym), NEVER, np.int64)
            at = np.flatnonzero(joined)
            rank[at] = self.pairs.ranks(sym[at], sym[at + 1])
            first = np.flatnonzero(np.r_[True, ~joined])
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(sym)])
            low = np.repeat(least, size)
            done = low == NEVER
            if done.any():
                yield sym[done], own[done]
                live = ~done
                sym, own, rank, low = sym[live], own[live], rank[live], low[live]
                if not len(sym):
                    return
            hit = rank == low
            # Of overlapping occurrences (a a a) every second one from the left merges.
            start = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], np.arange(len(hit)), -1))
            hit &= (np.arange(len(hit)) - start) % 2 == 0
            k = np.flatnonzero(hit)
            sym[k] = self.pairs.merged[rank[k]]
            keep = np.ones(len(sym), bool)
            keep[k + 1] = False
            sym, own = sym[keep], own[keep]

    def merged(self, sym: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, sequences) that merging leaves, in order."""
        done = list(self.merge(sym, own))
        ids, own = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        order = np.argsort(own, kind="stable")  # a sequence's symbols leave together, in their order
        return ids[order], own[order]

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their words) by rank-synchronous merging.

        A word of more than LONG symbols is merged in blocks, so that it doesn't take a round for each of its ranks.
        Ids that all fit side by side are what merging the whole gives; where blocks don't fit, the tokens about their
        border are merged anew together, more of them each time, until all fit.
        """
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        sym, own = self.symbols(words)
        first = np.searchsorted(own, np.arange(len(words)))
        block = (np.arange(len(sym)) - first[own]) // LONG
        new = np.r_[True, (own[1:] != own[:-1]) | (block[1:] != block[:-1])]
        ids, part = self.merged(sym.copy(), np.cumsum(new) - 1)
        word = own[new][part]
        border = np.flatnonzero((part[1:] != part[:-1]) & (word[1:] == word[:-1]))
        wide = 4
        while len(border):
            bad = border[~self.compatible(ids[border], ids[border + 1])]
            if not len(bad):
                break
            begin, end = np.searchsorted(word, word[bad]), np.searchsorted(word, word[bad], "right")
            lo, hi = np.maximum(bad - wide + 1, begin), np.minimum(bad + wide + 1, end)
            # Windows that meet become one.
            fresh = np.r_[True, (lo[1:] > np.maximum.accumulate(hi)[:-1]) | (word[bad][1:] != word[bad][:-1])]
            lo, hi = lo[fresh], np.maximum.reduceat(hi, np.flatnonzero(fresh))
            at = np.r_[0, np.cumsum(self.length[ids])]
            size = at[hi] - at[lo]
            inside = np.repeat(at[lo] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
            got, which = self.merged(sym[inside], np.repeat(np.arange(len(lo)), size))
            keep = np.ones(len(ids), bool)
            keep[np.repeat(lo - np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo) + np.arange(int((hi - lo).sum()))] = False
            place = np.r_[np.flatnonzero(keep), lo[which]]
            order = np.argsort(place, kind="stable")
            window = np.r_[np.full(int(keep.sum()), -1), which][order]
            ids, word = np.r_[ids[keep], got][order], np.r_[word[keep], word[lo][which]][order]
            border = np.flatnonzero((window[1:] != window[:-1]) & (word[1:] == word[:-1]))
            wide *= 2
        return ids, word

    def count_symbols(self, words: list[str]) -> np.ndarray:
        """Tokens of each word by rank-synchronous merging."""
        return np.bincount(self.tokens(words)[1], minlength=len(words))

    def exact(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word by merging."""
        ids, word = self.tokens(words)
        return np.split(ids, np.cumsum(np.bincount(word, minlength=len(words)))[:-1]) if words else []

    def longest_match(self, word: str) -> list[int]:
        out, p, n, inner, ended, reach, most = [], 0, len(word), self.vocab, self.ended, self.reach, self.longest_end
        while True:
            if n - p <= most and (t := ended.get(word[p:] if p else word)) is not None:
                out.append(t)
                return out
            t = None
            e = min(n - 1, p + reach.get(word[p : p + 2], 1))
            while e > p + 1 and (t := inner.get(word[p:e])) is None:
                e -= 1
            if t is None:
                t, e = inner[word[p]], p + 1
            out.append(t)
            p = e

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the symbols of left + right gives back these two tokens.

        Undo merges on both sides of the border from the latest on (of equal ranks the right-hand one); the pair falls
        if two parts that face each other would have merged before the merge that was undone last.
        """
        left, right = left.copy(), right.copy()
        ok = np.ones(len(left), bool)
        limit = np.full(len(left), NEVER, np.int64)  # a cross merge below the limit came first
        live = np.arange(len(left))
        while len(live):
            a, b = left[live], right[live]
            bad = self.pairs.ranks(a, b) < limit[live]
            ok[live[bad]] = False
            ma, mb = self.made[a], self.made[b]
            go = ~bad & ((ma >= 0) | (mb >= 0))
            live, a, b, ma, mb = live[go], a[go], b[go], ma[go], mb[go]
            undo = ma > mb
            limit[live] = np.where(undo, ma, mb + 1)
            left[live] = np.where(undo, self.hi[a], a)
            right[live] = np.where(undo, b, self.lo[b])
        return ok

    def speculate(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of all words, how many of them each word has, and how many words had to be merged exactly."""
        got = list(map(self.longest_match, words))
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.int64, int(size.sum()))
        own = np.repeat(np.arange(len(got)), size)
        good = np.ones(len(got), bool)
        if len(flat):
            # A token must itself be what merging makes of its text.
            good[own[~self.sound()[flat]]] = False
            at = np.flatnonzero(own[1:] == own[:-1])
            key, back = np.unique(flat[at] << 32 | flat[at + 1], return_inverse=True)
            fits = self.compatible(key >> 32, key & 0xFFFFFFFF)[back]
            good[own[at[~fits]]] = False
        bad = np.flatnonzero(~good)
        if len(bad):
            ids = self.exact([words[i] for i in bad.tolist()])
            n = np.array([len(x) for x in ids])
            flat, own = np.r_[flat[good[own]], np.concatenate(ids)], np.r_[own[good[own]], np.repeat(bad, n)]
            flat = flat[np.argsort(own, kind="stable")]
            size[bad] = n
        return flat, size, len(bad)

    def said(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Texts of ids, each with a blank behind, in UTF-8, and where each begins (and the last ends)."""
        if not hasattr(self, "_said"):
            raw = [(self.text.get(i, "") + " ").encode() for i in range(len(self.made))]
            self._said = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
        table, edge = self._said
        size = edge[ids + 1] - edge[ids]
        at = np.r_[0, np.cumsum(size)]
        return table[np.repeat(edge[ids] - at[:-1], size) + np.arange(at[-1])].tobytes(), at

    def sound(self) -> np.ndarray:
        """Of each token: whether merging its own text gives the token back, that is, whether its two halves face
        each other as one merge: both halves sound and not split by an earlier cross merge."""
        if not hasattr(self, "_sound"):
            ids = [i for i, t in self.text.items() if t not in self.specials and (t.endswith(self.suffix) or self.suffix)]
            ok = np.zeros(len(self.made), bool)
            inner, ended = [], []
            for i in ids:
                t = self.text[i]
                (ended if self.suffix and t.endswith(self.suffix) and len(t) > len(self.suffix) else inner).append(i)
            got = self.exact([self.text[i][: -len(self.suffix)] for i in ended])
            ok[[i for i, g in zip(ended, got, strict=True) if len(g) == 1 and g[0] == i]] = True
            # Without a word end: merge the text with the end symbol as an inner one.
            last, self.last = self.last, self.inner
            got = self.exact([self.text[i] for i in inner])
            self.last = last
            ok[[i for i, g in zip(inner, got, strict=True) if len(g) == 1 and g[0] == i]] = True
            self._sound = ok
        return self._sound


_CODERS: dict[str, WordBPE] = {}


def coder(path: str) -> WordBPE:
    if path not in _CODERS:
        _CODERS[path] = WordBPE(path)
    return _CODERS[path]


def _prepared(c: WordBPE, memo: Memo, value, batch: list[str]) -> Iterator[tuple[list[str], dict]]:
    """Words of each text, with the values of all of them; a chunk of text at a time."""
    for i, j in chunks(batch, 4 * CHUNK):
        part = [c.words(t) for t in batch[i:j]]
        new = memo.missing(set().union(*part))
        memo.put(*value(new))
        for p in part:
            yield p, memo.young


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, memo = coder(path), Memo()

        def value(new: list[str]) -> tuple[dict, int]:
            pre = [c.pretokens(w) for w in new]
            flat = [p for w in pre for p in w if isinstance(p, str)]
            n = c.count_symbols(flat)
            own = np.fromiter((i for i, w in enumerate(pre) for p in w if isinstance(p, str)), np.int64, len(flat))
            total = np.bincount(own, n, len(new)) if len(flat) else np.zeros(len(new))
            return {w: int(total[i]) + sum(not isinstance(p, str) for p in pre[i]) for i, w in enumerate(new)}, sum(map(len, new))

        for b in batches:
            t = texts(b)
            n = [sum(map(known.__getitem__, w)) for w, known in _prepared(c, memo, value, t)]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64()), "n_bytes": pa.array([len(x.encode("utf-8", "surrogatepass")) for x in t], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n])})

    return run


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of each row of ``docs(doc_id, text)`` for a word BPE file.

    Special tokens' strings in a text count as the one token that the library makes of them; none are added. Null and
    empty texts have no tokens; other columns are ignored; a null doc_id keeps its row. No shuffle.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_count(path or default_path(), limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def _code(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, memo = coder(path), Memo()

        def value(new: list[str]) -> tuple[dict, int]:
            pre = list(map(c.pretokens, new))
            own = np.repeat(np.arange(len(new)), np.fromiter(map(len, pre), np.int64, len(new)))
            parts = list(chain.from_iterable(pre))
            word = np.fromiter((isinstance(p, str) for p in parts), bool, len(parts))
            if word.all():
                ids, size, _ = c.speculate(parts)
            else:  # special tokens stand between
                some, n, _ = c.speculate([p for p in parts if isinstance(p, str)])
                size = np.ones(len(parts), np.int64)
                size[word] = n
                ids, mine = np.empty(int(size.sum()), np.int64), np.repeat(word, size)
                ids[mine], ids[~mine] = some, [p for p in parts if not isinstance(p, str)]
            edge = np.r_[0, np.cumsum(np.bincount(own, size, len(new)).astype(np.int64))]
            said, at = c.said(ids)
            raw, cut, where = ids.astype("<u4").tobytes(), (edge * 4).tolist(), at[edge].tolist()
            return {w: (raw[cut[i] : cut[i + 1]], said[where[i] : where[i + 1]]) for i, w in enumerate(new)}, len(raw) + len(said) + sum(map(len, new))

        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if with_ids else ()))}
            for words, known in _prepared(c, memo, value, texts(b)):
                pairs = list(map(known.__getitem__, words))
                raw = b"".join([p[0] for p in pairs])
                said = b"".join([p[1] for p in pairs])[:-1]
                out["n_tokens"].append(len(raw) // 4)
                out["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(said).hexdigest())
                if with_ids:
                    out["ids"].append(np.frombuffer(raw, np.uint32).astype(np.int32))
                    out["decoded"].append(said.decode())
            kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64()), **{k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()}})

    return run


def encode_decode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode each row of ``docs(doc_id, text)``: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, and
    with ``with_ids`` also ``ids array<int>`` and ``decoded``.

    Ids are those of the tokenizers library without added special tokens; decoding joins token texts as the library
    does for a file without a decoder. Null and empty texts give no ids and the empty decoded text; other columns are
    ignored; a null doc_id keeps its row. No shuffle.
    """
    small_batches(docs.sparkSession)
    more = ", ids array<int>, decoded string" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(_code(path or default_path(), with_ids), f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def op6_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
