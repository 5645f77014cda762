"""Suffix-array dedup: removes every byte that a 200-byte string covers which also starts anywhere else.

0. A text that occurs more than once is removed as a whole if it has 200 bytes; copies are counted by their hashes, and a
   task goes through a text once, however often it has it.
1. Anchors. The least 32-gram hash among the 169 that a 200-byte window holds depends on the window alone, so equal
   windows have equal anchors. Windows of a text that share their anchor make a *context* (about 284 bytes). A context
   whose anchor hash occurs nowhere else holds no repeated window.
2. Contexts that are equal as a whole are one class; a class of two or more is repeated as a whole.
3. Where an anchor hash has several different contexts, they meet in a shard, one copy of each class, and an external
   induced sort (``induced.suffix_order``) puts the shard's suffixes in order with their common prefixes: windows whose
   neighbours share 200 bytes are repeated. Where an anchor's contexts are more than a shard should hold, their windows
   are dealt one by one by a 128-bit hash of their 200 bytes instead, and equal ones are repeated.
4. Each text's repeated windows are joined into runs and cut out.
Positions travel as packed arrays dealt by a hash; texts are shuffled once per pass, equal texts once a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopath.llm.common import Bounded, drop_path, materialize, pack, shuffle_parts
from chronopath.llm.induced import END, suffix_order

WINDOW, GRAM, PIECE, SHARD_BYTES, TASK_BYTES = 200, 32, 1 << 20, 1 << 20, 64 << 20
U = np.uint64
_POS = U(PIECE - 1)
_TABLE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_MUL = [U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3)]


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each position on."""
    h, w = _TABLE[buf], 1
    for k in _MUL:
        h = h[:-w] * k + h[w:]
        w *= 2
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


def contexts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts buf[starts:ends] (at most PIECE bytes in all): (text, first window, windows, anchor hash) of each context."""
    if len(buf) < WINDOW:
        z = np.empty(0, np.int64)
        return z, z, z, np.empty(0, U)
    h = gram_hashes(buf)
    v = (h & ~_POS) | np.arange(len(h), dtype=U)
    span, w = WINDOW - GRAM + 1, 1
    while w * 2 <= span:
        v = np.minimum(v[:-w], v[w:])
        w *= 2
    v = np.minimum(v[: len(v) - (span - w)], v[span - w :])
    anchor = (v & _POS).astype(np.int64)
    owner = np.repeat(np.arange(len(starts)), ends - starts)[: len(anchor)]
    valid = np.arange(len(anchor)) + WINDOW <= ends[owner]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]
    at = np.flatnonzero(valid)
    if not len(at):
        z = np.empty(0, np.int64)
        return z, z, z, np.empty(0, U)
    cut = np.r_[True, new[at[1:]]]
    first = at[cut]
    count = np.diff(np.r_[np.flatnonzero(cut), len(at)])
    return owner[first], first, count, h[anchor[first]]


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid out in buffers of at most PIECE bytes: (buffer, text numbers, starts, ends, offsets in the texts).

    A longer text comes in pieces that overlap in all but one byte of a window, so that every window is in one.
    """
    part, who, off, held = [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - WINDOW + 1), PIECE - WINDOW + 1):
            p = t[a : a + PIECE]
            if len(p) < WINDOW:
                continue
            if held + len(p) > PIECE:
                e = np.cumsum([len(x) for x in part])
                yield np.frombuffer(b"".join(part), np.uint8), np.array(who), np.r_[0, e[:-1]], e, np.array(off)
                part, who, off, held = [], [], [], 0
            part.append(p)
            who.append(i)
            off.append(a)
            held += len(p)
    if part:
        e = np.cumsum([len(x) for x in part])
        yield np.frombuffer(b"".join(part), np.uint8), np.array(who), np.r_[0, e[:-1]], e, np.array(off)


def _raw(b: pa.RecordBatch, c: str = "text") -> list[bytes]:
    return [x or b"" for x in b.column(c).cast(pa.binary()).to_pylist()]


def _blob(bucket_name: str, packed: list, names: tuple, **fixed) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({bucket_name: pa.array([p[0] for p in packed], pa.int32()), **{k: pa.array([v] * len(packed), pa.int32()) for k, v in fixed.items()}, **{c: pa.array([p[1][i] for p in packed], pa.binary()) for i, c in enumerate(names)}})


_A = ("h", "ctx", "k1", "k2", "pos", "n")


def _anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _first_seen(batches):
            raw = _raw(b)
            k1, k2 = (np.asarray(b.column(c), dtype=np.int64) for c in ("k1", "k2"))
            got: list[list[np.ndarray]] = [[] for _ in _A]
            for buf, who, starts, ends, off in pieces(raw):
                own, first, count, h = contexts(buf, starts, ends)
                view = memoryview(buf.tobytes())
                one = xxhash.xxh3_64_intdigest
                ctx = np.fromiter((one(view[s:e]) for s, e in zip(first.tolist(), (first + count + WINDOW - 1).tolist(), strict=True)), U, len(first))
                text = who[own]
                for to, x in zip(got, (h, ctx, k1[text], k2[text], (first - starts[own] + off[own]).astype(np.uint32), count.astype(np.uint32)), strict=True):
                    to.append(x)
            if got[0]:
                cols = [np.concatenate(x) for x in got]
                yield _blob("bucket", list(pack((cols[0] % U(buckets)).astype(np.int32), cols)), _A)

    return run


_KIND = {"h": U, "ctx": U, "k1": np.int64, "k2": np.int64, "pos": np.uint32, "n": np.uint32, "flag": np.uint8}


def _read(batches: Iterator[pa.RecordBatch], names: tuple) -> dict[str, np.ndarray]:
    got: dict[str, list] = {c: [] for c in names}
    for b in batches:
        for c in names:
            got[c] += [np.frombuffer(x, _KIND[c]) for x in b.column(c).to_pylist()]
    return {c: np.concatenate(x) if x else np.empty(0, _KIND[c]) for c, x in got.items()}


_S = ("k1", "k2", "pos", "n", "h", "flag")


def _statuses(parts: int, hot: int = SHARD_BYTES):
    """kind 0: contexts repeated as a whole; kind 1: contexts whose suffixes have to be sorted (flag: also repeated as a whole).

    kind 2: as kind 1, of anchors whose different contexts have more than ``hot`` bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _read(batches, _A)
        if not len(x["h"]):
            return
        o = np.argsort(x["h"])
        h = x["h"][o]
        same = h[1:] == h[:-1]
        o = o[np.r_[same, False] | np.r_[False, same]]
        o = o[np.lexsort((x["ctx"][o], x["h"][o]))]
        x = {c: v[o] for c, v in x.items()}
        if not len(o):
            return
        new_h = np.r_[True, x["h"][1:] != x["h"][:-1]]
        new_c = new_h | np.r_[True, x["ctx"][1:] != x["ctx"][:-1]]
        c_id, h_id = np.cumsum(new_c) - 1, np.cumsum(new_h) - 1
        whole = np.bincount(c_id)[c_id] > 1
        many = np.bincount(h_id[new_c])[h_id] > 1
        x["flag"] = whole.astype(np.uint8)
        large = np.bincount(h_id[new_c], x["n"][new_c].astype(np.float64) + WINDOW)[h_id] > hot
        # Copies of a text that other tasks had as well have the same place; it is told once.
        place = np.flatnonzero(whole)
        by = np.lexsort((x["pos"][place], x["k2"][place], x["k1"][place]))
        place = place[by]
        place = place[np.r_[True, (x["k1"][place][1:] != x["k1"][place][:-1]) | (x["k2"][place][1:] != x["k2"][place][:-1]) | (x["pos"][place][1:] != x["pos"][place][:-1])]] if len(place) else place
        for kind, at in ((0, place), (1, np.flatnonzero(many & new_c & ~large)), (2, np.flatnonzero(many & new_c & large))):
            if len(at):
                packed = list(pack(np.mod(x["k1"][at], parts).astype(np.int32), [x[c][at] for c in _S]))
                sizes = [int(np.frombuffer(p[1][3], np.uint32).sum()) + WINDOW * (len(p[1][5])) for p in packed]
                yield _blob("part", packed, _S, kind=kind).append_column("bytes", pa.array(sizes, pa.int64()))

    return run


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts leave a task once: a text of very many copies doesn't fill the partition that it is dealt to."""
    seen = Bounded(500_000)
    for b in batches:
        keep = []
        for i, k in enumerate(zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), strict=True)):
            if k not in seen:
                seen.room(1)
                seen[k] = True
                keep.append(i)
        yield b.take(pa.array(keep, pa.int64()))


def _routed(batches: Iterator[pa.RecordBatch], names: tuple) -> Iterator[tuple[dict[str, np.ndarray] | None, pa.RecordBatch | None]]:
    """First all packed rows (their kind is not null) as arrays ordered by key, then the batches of texts."""
    got: dict[str, list] = {c: [] for c in (*names, "kind")}
    told = False
    for b in batches:
        packed = b.filter(pc.is_valid(b.column("kind")))
        for c in names:
            got[c] += [np.frombuffer(x, _KIND[c]) for x in packed.column("b_" + c).to_pylist()]
        got["kind"] += [np.full(len(x) // 8, k, np.uint8) for x, k in zip(packed.column("b_k1").to_pylist(), packed.column("kind").to_pylist(), strict=True)]
        rest = b.filter(pc.is_null(b.column("kind")))
        if rest.num_rows:
            if not told:
                x = {c: np.concatenate(v) if v else np.empty(0, _KIND.get(c, np.uint8)) for c, v in got.items()}
                o = np.lexsort((x["k2"], x["k1"]))
                yield {c: v[o] for c, v in x.items()}, None
                told = True
            yield None, rest


def _slice(x: dict[str, np.ndarray], k1: int, k2: int) -> slice:
    a, b = np.searchsorted(x["k1"], k1, "left"), np.searchsorted(x["k1"], k1, "right")
    return slice(a + np.searchsorted(x["k2"][a:b], k2, "left"), a + np.searchsorted(x["k2"][a:b], k2, "right"))


_C = ("k1", "k2", "pos", "n", "flag")


def _fetch(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: dict = {}
        served = set()

        def out(cols, bodies):
            c = {k: np.concatenate(v) for k, v in cols.items()}
            shard = (c["h"] % U(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            packed = list(pack(shard, [c[k] for k in _C]))
            cuts = np.cumsum([0] + [len(p[1][4]) for p in packed])
            text = [b"".join([bodies[i] for i in order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return _blob("shard", packed, _C).append_column("body", pa.array(text, pa.large_binary() if False else pa.binary()))

        cols, bodies, held = {k: [] for k in (*_C, "h")}, [], 0
        for got, b in _routed(batches, _S):
            if got is not None:
                x = got
                continue
            for k1, k2, t in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), _raw(b), strict=True):
                at = _slice(x, k1, k2)
                if at.start == at.stop or (k1, k2) in served:
                    continue
                served.add((k1, k2))
                for k in cols:
                    cols[k].append(x[k][at])
                for p, n in zip(x["pos"][at].tolist(), x["n"][at].tolist(), strict=True):
                    bodies.append(t[p : p + n + WINDOW - 1] + bytes([END]))
                    held += n + WINDOW
                if held > 16 << 20:
                    yield out(cols, bodies)
                    cols, bodies, held = {k: [] for k in (*_C, "h")}, [], 0
        if bodies:
            yield out(cols, bodies)

    return run


_W = "w1 long, w2 long, k1 long, k2 long, pos long, weight int"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the contexts: hash, place, and 2 as the weight of those that are also repeated as a whole."""
    x: dict = {}
    served = set()
    names = [c.split()[0] for c in _W.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.int32()]
    rows: list[tuple] = []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for got, b in _routed(batches, _S):
        if got is not None:
            x = got
            continue
        for k1, k2, t in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), _raw(b), strict=True):
            at = _slice(x, k1, k2)
            if at.start == at.stop or (k1, k2) in served:
                continue
            served.add((k1, k2))
            view = memoryview(t)
            for p, n, f in zip(x["pos"][at].tolist(), x["n"][at].tolist(), x["flag"][at].tolist(), strict=True):
                for i in range(p, p + n):
                    d = xxhash.xxh3_128_digest(view[i : i + WINDOW])
                    rows.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), k1, k2, i, 1 + f))
                if len(rows) > 20_000:
                    yield out()
                    rows = []
    if rows:
        yield out()


def _placed(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = [b.column(c).to_numpy().astype(_KIND[c]) for c in ("k1", "k2", "pos")]
                cols.append(np.ones(b.num_rows, np.uint32))
                yield _blob("part", list(pack(np.mod(cols[0], parts).astype(np.int32), cols)), _R)

    return run


_R = ("k1", "k2", "pos", "n")


def _sort(parts: int, memory: int):
    """Suffix order of each shard; repeated windows of contexts that are not repeated as a whole, as runs."""

    def shard(x: dict[str, np.ndarray], body: bytes) -> pa.RecordBatch | None:
        start = np.r_[0, np.cumsum(x["n"].astype(np.int64) + WINDOW)]
        weight = np.zeros(len(body), np.uint8)
        for s, n, f in zip(start[:-1].tolist(), x["n"].tolist(), x["flag"].tolist(), strict=True):
            weight[s : s + n] = 1 + f
        marked = []
        for pos, lcp in suffix_order(body, WINDOW, memory):
            w = weight[pos]
            group = np.cumsum(lcp < WINDOW)
            total = np.bincount(group, weights=w)
            marked.append(pos[(w == 1) & (total[group] >= 2)])
        at = np.sort(np.concatenate(marked)).astype(np.int64) if marked else np.empty(0, np.int64)
        if not len(at):
            return None
        own = np.searchsorted(start, at, "right") - 1
        cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])])
        n = np.diff(np.r_[cut, len(at)]).astype(np.uint32)
        c, own = at[cut], own[cut]
        cols = [x["k1"][own], x["k2"][own], (x["pos"][own] + (c - start[own])).astype(np.uint32), n]
        return _blob("part", list(pack(np.mod(cols[0], parts).astype(np.int32), cols)), _R)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, got = None, None

        def done():
            x = {c: np.concatenate([np.frombuffer(v, _KIND[c]) for v in got[c]]) for c in _C}
            return shard(x, b"".join(got["body"]))

        for b in batches:
            for i, s in enumerate(b.column("shard").to_pylist()):
                if s != number:
                    if got and (r := done()):
                        yield r
                    number, got = s, {c: [] for c in (*_C, "body")}
                for c in got:
                    got[c].append(b.column(c)[i].as_py())
        if got and (r := done()):
            yield r

    return run


def cut(raw: bytes, pos: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed runs [start, end) given runs of repeated windows."""
    if not len(pos):
        return []
    o = np.argsort(pos, kind="stable")
    a, b = pos[o].astype(np.int64), np.maximum.accumulate(pos[o].astype(np.int64) + n[o] + WINDOW - 1)
    first = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
    return list(zip(a[first].tolist(), b[np.r_[first[1:] - 1, len(b) - 1]].tolist(), strict=True))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    x: dict = {}
    served = set()
    for got, b in _routed(batches, _R):
        if got is not None:
            x = got
            continue
        rows: dict[str, list] = {c: [] for c in ("k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
        for k1, k2, t in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), _raw(b), strict=True):
            if (k1, k2) in served:
                continue
            served.add((k1, k2))
            at = _slice(x, k1, k2)
            runs = cut(t, x["pos"][at], x["n"][at])
            kept, p = [], 0
            for s, e in runs:
                kept.append(t[p:s])
                p = e
            kept = b"".join([*kept, t[p:]])
            for c, v in zip(rows, (k1, k2, len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), runs, kept.decode("utf-8", "ignore")), strict=True):
                rows[c].append(v)
        span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        kinds = {"kept_sha256": pa.string(), "kept": pa.string(), "spans": span}
        rows["spans"] = [[{"s": s, "e": e} for s, e in r] for r in rows["spans"]]
        yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in rows.items()})


def repeated_spans(docs: DataFrame, memory: int = 256 << 20, keep_text: bool = False, hot: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256, spans (array of byte ranges) and, if asked, kept text.

    ``docs`` needs ``text``; all its columns but the text are kept unless their names are among those above, which the
    results replace. A null text is empty. Matches never cross texts; equal texts are matches of each other, and so are
    overlapping strings of one text. Texts under 200 bytes lose nothing. ``kept`` decodes what is left, leaving out
    characters that a cut has split. ``memory`` bounds the sorter's queues in bytes; beyond it they go to scratch disk.
    Anchors with more than ``hot`` bytes of different contexts are settled window by window, by joins.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark) * 2
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *(["kept"] if keep_text else [])]
    t = F.coalesce(F.col("text"), F.lit("")).alias("text")
    keyed = docs.select(t).select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"), "text")
    blob = lambda names: ", ".join(f"{c} binary" for c in names)
    anchors = keyed.where(f"octet_length(text) >= {WINDOW}").mapInArrow(_anchors(parts), f"bucket int, {blob(_A)}")
    status, status_path = materialize(anchors.repartition(shuffle_parts(spark), "bucket").mapInArrow(_statuses(parts, hot), f"part int, kind int, {blob(_S)}, bytes long"), "suffix-status")
    sizes = {r.kind: r.b for r in status.groupBy("kind").agg(F.sum("bytes").alias("b")).collect()}
    total = sizes.get(1, 0)
    # A task sorts its shards one after the other, so a worker holds the arrays of about a megabyte of contexts.
    shards = max(shuffle_parts(spark), total // SHARD_BYTES + 1)
    tasks = max(shuffle_parts(spark), total // TASK_BYTES + 1)
    distinct = keyed.mapInArrow(_first_seen, "k1 long, k2 long, text string").withColumn("part", F.expr(f"cast(pmod(k1, {parts}) as int)"))

    def routed(packed: DataFrame, names: tuple, texts: DataFrame) -> DataFrame:
        left = packed.select("part", "kind", *[F.col(c).alias("b_" + c) for c in names])
        both = left.unionByName(texts, allowMissingColumns=True).select("part", "kind", *["b_" + c for c in names], "k1", "k2", "text")
        return both.repartition(shuffle_parts(spark), "part").sortWithinPartitions(F.col("kind").asc_nulls_last())

    found, done = spark.createDataFrame([], f"part int, {blob(_R)}"), [status_path]
    if total:
        bodies = routed(status.where("kind = 1"), _S, distinct).mapInArrow(_fetch(shards), f"shard int, {blob(_C)}, body binary")
        found, found_path = materialize(bodies.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_sort(parts, memory), f"part int, {blob(_R)}"), "suffix-found")
        done.append(found_path)
    if sizes.get(2):
        windows, windows_path = materialize(routed(status.where("kind = 2"), _S, distinct).mapInArrow(_windows, _W), "suffix-windows")
        again = windows.groupBy("w1", "w2").agg(F.sum("weight").alias("total")).where("total > 1").select("w1", "w2")
        marked = windows.where("weight = 1").join(again, ["w1", "w2"], "left_semi").select("k1", "k2", "pos")
        placed, placed_path = materialize(marked.mapInArrow(_placed(parts), f"part int, {blob(_R)}"), "suffix-placed")
        found = found.union(placed)
        drop_path(spark, windows_path)
        done.append(placed_path)
    runs = status.where("kind = 0").select("part", "kind", *_R).union(found.select("part", F.lit(0).alias("kind"), *_R))
    cleaned = routed(runs, _R, distinct).mapInArrow(_remove, "k1 long, k2 long, n_bytes long, n_removed long, n_spans int, kept_sha256 string, spans array<struct<s: long, e: long>>, kept string".replace("n_spans int", "n_spans long"))
    often = keyed.where(f"octet_length(text) >= {WINDOW}").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("k1", "k2", F.lit(True).alias("_often"))
    gone = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("long"), "kept_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "spans": F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("n_bytes").alias("e"))), "kept": F.lit("")}
    cleaned = cleaned.join(often, ["k1", "k2"], "left").withColumns({c: F.when(F.col("_often"), v).otherwise(F.col(c)) for c, v in gone.items()})
    cleaned, _ = materialize(cleaned.select("k1", "k2", *made).withColumnsRenamed({c: "r_" + c for c in made}), "suffix-cleaned")
    drop_path(spark, *done)
    rest = [c for c in docs.columns if c != "text" and c not in made]
    ids = docs.select(*rest, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_k1"), F.xxhash64(F.lit(7), F.coalesce("text", F.lit(""))).alias("_k2"))
    cleaned = cleaned.withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    return ids.join(cleaned, ["_k1", "_k2"]).select(*rest, *[F.col("r_" + c).alias(c) for c in made])


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_spans(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
