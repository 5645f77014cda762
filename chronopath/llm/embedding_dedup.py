"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs.

Every vector goes to a few buckets of each hash table: its own and those that it comes closest to. How many hashes make
up a bucket's key grows with the logarithm of the rows, so that buckets stay small. Only (bucket, vector number) pairs
are dealt out, packed; members of a small bucket become candidate pairs, which fetch their vectors once, and members of
a large one meet block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopath.llm.common import components, drop_path, forget_shuffles, materialize, pack, shuffle_parts
from chronopath.llm.ngram_join import _K, mix

SEED, NEAREST = 20240607, 3
BLOCK, SMALL, ROWS = 2048, 16, 1024
#: Exact copies of one vector above this number (and a thousandth of all rows) are joined by broadcast.
HOT = 10_000
U = np.uint64


def plan(rows: int, size: int) -> tuple[int, int, int]:
    """(hashes a table, tables, probes) for labels of up to ``rows`` vectors of ``size`` rotated dimensions.

    The fewest hashes for which a bucket holds about one stranger; more hashes need more probes and tables for the same
    recall (tests measure it at the threshold).
    """
    k = 2
    while k < 6 and rows * 4 * (k - 1) > (2 * size) ** k:
        k += 1
    return k, 2 * k + 2, 4 * (k - 1)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (row length a power of two), unnormalised."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def bucket_keys(x: np.ndarray, hashes: int = 2, tables: int = 6, probes: int = 4, seed: int = SEED) -> np.ndarray:
    """Keys [rows, tables, probes] of unit vectors, each of several cross-polytope hashes; the own bucket is among them.

    Probes take, for every hash, one of the NEAREST vertices, in order of the squared scores that are given up.
    """
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    wide = np.zeros((n, size), np.float32)
    wide[:, :d] = x
    near = min(size, NEAREST)
    choice = np.stack(np.meshgrid(*[np.arange(near)] * hashes, indexing="ij"), -1).reshape(-1, hashes)
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        cost, key = np.zeros((n, len(choice)), np.float32), np.zeros((n, len(choice)), U)
        for k in range(hashes):
            rng = np.random.default_rng([seed, t, k, size])
            r = wide
            for _ in range(3):
                r = hadamard(r * rng.choice([-1.0, 1.0], size).astype(np.float32)) / np.float32(np.sqrt(size))
            a = np.abs(r)
            top = np.argpartition(-a, near - 1, axis=1)[:, :near]
            val = np.take_along_axis(a, top, 1)
            order = np.argsort(-val, axis=1, kind="stable")
            top, val = np.take_along_axis(top, order, 1), np.take_along_axis(val, order, 1)
            vertex = (top * 2 + (np.take_along_axis(r, top, 1) < 0)).astype(U)
            cost += ((val[:, :1] - val) ** 2)[:, choice[:, k]]
            key = mix(key * _K[0] + vertex[:, choice[:, k]] + U(1))
        some = min(probes, len(choice))
        best = np.argpartition(cost, some - 1, axis=1)[:, :some]
        out[:, t, :some] = np.take_along_axis(key, best, 1).view(np.int64)
        out[:, t, some:] = out[:, t, :1]
    return out


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column without nulls."""
    off = np.asarray(column.offsets)
    return np.asarray(column.values.slice(off[0], off[-1] - off[0]), dtype=np.float64), off - off[0]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes of doubles."""
    for b in batches:
        flat, off = _vectors(b.column("embedding"))
        vec = []
        for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            # Dividing by the largest entry first keeps huge and tiny vectors from overflowing.
            v = flat[s:e] / np.abs(flat[s:e]).max()
            vec.append((v / np.sqrt((v * v).sum())).tobytes())
        yield pa.RecordBatch.from_pydict({"rep": b.column("rep"), "label": b.column("label"), "mult": b.column("mult"), "vec": pa.array(vec, pa.binary())})


def _hash(hashes: int, tables: int, probes: int, buckets: int):
    """Packed (bucket key, vector number) of all probes; the key holds label, length and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec, rep, label = b.column("vec").to_pylist(), np.asarray(b.column("rep")), np.asarray(b.column("label"))
            dims = np.array([len(v) // 8 for v in vec])
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                for lo in range(0, len(rows), ROWS):
                    at = rows[lo : lo + ROWS]
                    x = np.frombuffer(b"".join([vec[i] for i in at.tolist()]), np.float64).reshape(len(at), d)
                    keys = bucket_keys(x, hashes, tables, probes).view(U)
                    keys = mix(keys ^ mix(np.arange(tables, dtype=U) * _K[1] + U(d))[None, :, None] ^ mix(label[at].astype(np.int64).view(U) * _K[2])[:, None, None])
                    sig, who = keys.reshape(-1), np.repeat(rep[at], tables * probes)
                    packed = list(pack((sig % U(buckets)).astype(np.int32), [sig, who]))
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([p[0] for p in packed], pa.int32()), "sig": pa.array([p[1][0] for p in packed], pa.binary()), "who": pa.array([p[1][1] for p in packed], pa.binary())})

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: pairs of vector numbers that share a small bucket; kind 1: (key, member) of large ones. One packed bucket,
    of bounded size on average, is held at a time; rows come sorted by it."""

    def of(sig: np.ndarray, who: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((who, sig))
        sig, who = sig[order], who[order]
        fresh = np.r_[True, (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])]
        sig, who = sig[fresh], who[fresh]
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        count = np.diff(np.r_[first, len(sig)])
        grp, left, right = np.repeat(np.arange(len(first)), count), [], []
        small = (count <= SMALL)[grp]
        for d in range(1, SMALL):
            i = np.flatnonzero(small[:-d] & (grp[:-d] == grp[d:])) if len(grp) > d else np.empty(0, np.int64)
            left.append(who[i])
            right.append(who[i + d])
        pair = np.stack([np.concatenate(left), np.concatenate(right)], 1)
        pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
        if len(pair):
            pair = pair[np.r_[True, (pair[1:] != pair[:-1]).any(1)]]
        big = np.flatnonzero(~small)
        for kind, a, c in ((0, pair[:, 0], pair[:, 1]), (1, sig[big].view(np.int64), who[big])):
            for lo in range(0, len(a), 100_000):
                m = len(a[lo : lo + 100_000])
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(m, kind, np.int32)), "a": pa.array(a[lo : lo + 100_000]), "b": pa.array(c[lo : lo + 100_000])})

    key, held = None, ([], [])
    for b in batches:
        for k, s, w in zip(*(b.column(c).to_pylist() for c in ("bucket", "sig", "who")), strict=True):
            if k != key:
                if held[0]:
                    yield from of(*map(np.concatenate, held))
                key, held = k, ([], [])
            held[0].append(np.frombuffer(s, U))
            held[1].append(np.frombuffer(w, np.int64))
    if held[0]:
        yield from of(*map(np.concatenate, held))


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the rows of x and y reach the threshold: by numpy's plain sum, so that it doesn't depend on the block."""
    return (x * y).sum(1) >= threshold


def _exact(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            va, vb = b.column("va").to_pylist(), b.column("vb").to_pylist()
            ok = np.array([len(p) == len(q) and bool(_linked(np.frombuffer(p)[None], np.frombuffer(q)[None], threshold)[0]) for p, q in zip(va, vb, strict=True)], bool)
            yield b.select(["a", "b", "ma", "mb"]).filter(pa.array(ok))

    return run


def _verify(threshold: float):
    """Blocks of large buckets, rows sorted by block: how many vectors each links with, and a tie to its component.

    A pair counts in the least large bucket that both share; a block pair never exceeds two blocks.
    """

    def shared(bigs: list, sig: int) -> np.ndarray:
        """Bits of the lesser large buckets that occur more than once among the rows."""
        flat = np.array([s for b in bigs for s in b if s < sig], np.int64)
        own = np.repeat(np.arange(len(bigs)), [sum(s < sig for s in b) for b in bigs])
        keys, at, n = np.unique(flat, return_inverse=True, return_counts=True)
        kept = np.cumsum(n > 1) - 1
        bit = np.zeros((len(bigs), max(64, -(-int((n > 1).sum()) // 64) * 64)), bool)
        use = n[at] > 1
        bit[own[use], kept[at[use]]] = True
        return np.packbits(bit, axis=1).view(U)

    def pairs(g: dict) -> dict | None:
        n = len(g["rep"])
        rep, mult, blk, label = (np.array(g[k]) for k in ("rep", "mult", "blk", "label"))
        dim = np.array([len(v) for v in g["vec"]])
        deg, tied = np.zeros(n, np.int64), np.arange(n)
        mask = shared(g["bigs"], g["sig"])
        for kind in sorted({*zip(label.tolist(), dim.tolist(), strict=True)}):  # one, but for keys that collide
            rows = np.flatnonzero((label == kind[0]) & (dim == kind[1]))
            x = np.frombuffer(b"".join([g["vec"][i] for i in rows.tolist()]), np.float64).reshape(len(rows), -1)
            for a in range(0, len(rows), 512):
                i, j = np.nonzero(x[a : a + 512] @ x.T >= threshold - 1e-9)
                p, q = rows[i + a], rows[j]
                keep = (rep[p] < rep[q]) & (True if g["i"] == g["j"] else blk[p] != blk[q])
                i, j, p, q = (i + a)[keep], j[keep], p[keep], q[keep]
                for s in range(0, len(p), 20_000):
                    part = slice(s, s + 20_000)
                    ok = _linked(x[i[part]], x[j[part]], threshold) & ~(mask[p[part]] & mask[q[part]]).any(1)
                    u, v = p[part][ok], q[part][ok]
                    np.add.at(deg, u, mult[v])
                    np.add.at(deg, v, mult[u])
                    while True:  # smallest row index reachable, by pointer jumping
                        lo, was = np.minimum(tied[u], tied[v]), tied.copy()
                        for at in (tied[u], tied[v], u, v):
                            np.minimum.at(tied, at, lo)
                        tied = tied[tied]
                        if (was == tied).all():
                            break
        at = np.flatnonzero((deg > 0) | (tied != np.arange(n)))
        return {"rep": rep[at], "deg": deg[at], "to": rep[tied[at]]} if len(at) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, g = None, None
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in ("rep", "mult", "label", "vec", "bigs", "blk")}
            for r, k in enumerate(zip(*(b.column(c).to_pylist() for c in ("sig", "i", "j")), strict=True)):
                if k != key:
                    if g and (out := pairs(g)):
                        yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})
                    key, g = k, {"sig": k[0], "i": k[1], "j": k[2], **{c: [] for c in cols}}
                for c, v in cols.items():
                    g[c].append(v[r])
        if g and (out := pairs(g)):
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Near-duplicate classes of ``vectors(vec_id, embedding, label)``.

    Rows ``(vec_id, n_links, component_id, kept)``, one per input row. Vectors link within a label (not null) at
    cosine >= ``threshold`` in double precision. Null or zero vectors and vectors with null or non-finite entries
    link with nothing. Vectors of different lengths never link. Equal vectors of a label form one class that is hashed
    once and counted by its size. Buckets above SMALL members are split into blocks and every pair of blocks is
    compared by its own task group, so no bucket is capped. Recall is that of the hash tables (tests measure it
    against brute force); no pair below the threshold is reported. Extra columns are ignored; a null vec_id is a row
    that links with nothing (component_id null). Vector ids are taken to be unique; rows that share one and differ in
    vector or label are vectors of their own with the same number, and linked with each other by it.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)["label"]
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise ValueError(f"labels must be whole numbers, not {kind}")
    e = F.col("embedding")
    ok = "vec_id is not null and label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    src = vectors.select("vec_id", F.col("label").cast("long").alias("label"), e.cast("array<double>").alias("embedding"))
    good = src.where(ok)
    classes, classes_path = materialize(good.groupBy("label", "embedding").agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("mult")), "classes")
    units, units_path = materialize(classes.mapInArrow(_units, "rep long, label long, mult long, vec binary"), "units")
    # Of the largest label, and of the shortest vectors: their tables have the fewest buckets.
    most = classes.groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("d")).agg(F.max("n"), F.min("d"), F.sum("n")).first()
    hashes, tables, probes = plan(most[0] or 0, 1 << max(1, ((most[1] or 1) - 1).bit_length()))
    parts = shuffle_parts(spark)
    buckets = max(parts * 4, (most[2] or 0) * tables * probes * 16 // (8 << 20) + 1)
    packed = units.mapInArrow(_hash(hashes, tables, probes, buckets), "bucket int, sig binary, who binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    met, met_path = materialize(packed.mapInArrow(_meet, "kind int, a long, b long"), "met")
    pairs = met.where("kind = 0").select("a", "b").distinct()
    member = met.where("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("rep"))
    large = member.limit(1).count() > 0
    bigs = member.groupBy("rep").agg(F.sort_array(F.collect_set("sig")).alias("bigs"))  # at most one key a probe
    if large:  # pairs that share a large bucket as well are counted there
        for k in "ab":
            pairs = pairs.join(bigs.withColumnsRenamed({"rep": k, "bigs": "b" + k}), k, "left")
        pairs = pairs.where("not coalesce(arrays_overlap(ba, bb), false)").select("a", "b")
    one, two = (units.select(F.col("rep").alias(k), F.col("label").alias("l" + k), F.col("mult").alias("m" + k), F.col("vec").alias("v" + k)) for k in "ab")
    close = pairs.join(one, "a").join(two, "b").where("la = lb").select("a", "b", "ma", "mb", "va", "vb")
    links, links_path = materialize(close.mapInArrow(_exact(threshold), "a long, b long, ma long, mb long"), "links")
    found = links.select(F.col("a").alias("rep"), F.col("mb").alias("deg"), F.col("b").alias("to")).union(links.select("b", "ma", "a"))
    paths = [classes_path, units_path, met_path, links_path]
    if large:
        sizes = member.groupBy("sig").agg(F.count("*").alias("n"))
        dealt = member.join(sizes, "sig").withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("blk", F.expr("cast(pmod(xxhash64(rep), nb) as int)"))
        dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)"))).withColumn("i", F.least("blk", "other")).withColumn("j", F.greatest("blk", "other"))
        dealt = dealt.join(units, "rep").join(bigs, "rep").select("sig", "i", "j", "rep", "mult", "label", "vec", "bigs", "blk")
        more, more_path = materialize(dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(_verify(threshold), "rep long, deg long, to long"), "found")
        found = found.union(more)
        paths.append(more_path)
    comp, comp_path = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    degrees = found.groupBy("rep").agg(F.sum("deg").alias("deg"))
    facts = classes.join(degrees, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    facts = facts.select("label", "embedding", "mult", (F.coalesce("deg", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    facts, facts_path = materialize(facts, "vector-facts")
    # Copies of one vector may be a third of all rows: classes above a thousandth of them are a thousand at most.
    rows = classes.agg(F.sum("mult")).first()[0] or 0
    drop_path(spark, *paths, comp_path)
    forget_shuffles(spark)
    key, least = ["label", "embedding"], max(HOT, rows // 1000)
    hot = F.broadcast(facts.where(F.col("mult") >= least).drop("mult"))
    linked = good.join(hot, key).select("vec_id", "n_links", "component_id").union(good.join(hot, key, "left_anti").join(facts.where(F.col("mult") < least), key).select("vec_id", "n_links", "component_id"))
    alone = src.where(F.expr(ok).isNull() | ~F.expr(ok)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
