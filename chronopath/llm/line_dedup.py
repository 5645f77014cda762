"""Incremental line dedup that can be undone: sharded cuckoo filters before exact reference counts.

An index lives in a shared folder and takes documents in (``insert``) and out (``delete``):

* ``refs``: a row for each document put in or taken out, with the 128-bit keys of its long lines, each once.
* ``counts``: for each key how many documents hold it and the largest doc_id among them. Exact; runs of it are added to,
  and written anew after a deletion.
* ``filters``: for each shard (the leading bits of a key) a cuckoo filter of the keys that at least ``min_docs``
  documents hold. Keys that come to that count are put in, those that fall below it are taken out; a filter that is
  full is built again from the counts.

``apply`` deals the references to shards, split where a shard has more than its share. There the filter turns most of
them away, the exact table decides on the rest, and what is to go travels to its documents.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from chronopath.llm.common import drop_path, materialize, pack, shared_dir, small_batches
from chronopath.llm.cuckoo import Cuckoo

BLANKS = b" \t\n\x0b\x0c\r"
NONE = -(1 << 63)  # stands for a missing doc_id in arrays
HELD = 1 << 19  # references that a task holds at a time
LEAST_BITS, MOST_BITS, SHARD_REFS = 8, 12, 1 << 20
_STATE = "version long, bits int, min_docs int, min_chars int, refs array<string>, counts array<string>, filters string, deleted boolean"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Digest of a line without blanks about it and with A-Z in lower case; None under ``min_chars`` code points."""
    k = line.strip(BLANKS).lower()  # of bytes: nothing but A-Z changes
    if len(k) < min_chars or (len(k) < 4 * min_chars and len(k.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(k)


def _raw(b: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]


def _extract(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [b"".join({k for line in t.split(b"\n") if (k := line_key(line, min_chars))}) for t in _raw(b)]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "row": b.column("row"), "keys": pa.array(keys, pa.binary())})

    return run


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a batch of documents as pairs of longs, and the doc_id and row of each."""
    blobs = b.column("keys").to_pylist()
    n = [len(x) // 16 for x in blobs]
    ids = b.column("doc_id").fill_null(NONE).to_numpy(zero_copy_only=False)
    return np.frombuffer(b"".join(blobs), "<i8").reshape(-1, 2), np.repeat(ids, n), np.repeat(b.column("row").to_numpy(zero_copy_only=False), n)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    got: list = []
    for b in batches:
        got.append(_flat(b))
        if sum(len(x[0]) for x in got) >= HELD:
            yield tuple(np.concatenate(x) for x in zip(*got, strict=True))
            got = []
    if got:
        yield tuple(np.concatenate(x) for x in zip(*got, strict=True))


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the task's documents hold a key, and the largest doc_id: a line of all documents is a row a task."""
    for keys, ids, _ in _held(batches):
        if not len(keys):
            continue
        o = np.lexsort((ids, keys[:, 1], keys[:, 0]))
        k = keys[o]
        last = np.r_[(k[1:] != k[:-1]).any(1), True]
        top = ids[o][last]
        yield pa.RecordBatch.from_pydict({"k1": k[last, 0], "k2": k[last, 1], "n": np.diff(np.r_[-1, np.flatnonzero(last)]), "top": pa.array(top, pa.int64(), mask=top == NONE)})


def _by_shard(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Columns of each shard from rows in the order of shards."""
    number, got = None, []
    for b in batches:
        shard = b.column("shard").to_numpy(zero_copy_only=False)
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
        for s in np.unique(shard):
            if s != number and number is not None:
                yield number, [np.concatenate(x) for x in zip(*got, strict=True)]
                got = []
            number = int(s)
            got.append([c[shard == s] for c in cols])
    if number is not None:
        yield number, [np.concatenate(x) for x in zip(*got, strict=True)]


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, (k1, k2) in _by_shard(batches, ("k1", "k2")):
        keys, size = np.stack([k1, k2], 1), len(k1)
        while not (f := Cuckoo.empty(size)).insert(keys):
            size *= 2
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "filter": pa.array([f.table.tobytes()], pa.binary())})


def _change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters after keys went in (step 1) and out (step -1); null where they didn't find room."""

    def done(shard: int, filt: Cuckoo | None, keys: dict) -> pa.RecordBatch:
        part = {s: np.concatenate(v) if v else np.empty((0, 2), np.int64) for s, v in keys.items()}
        blob = None
        if filt is not None:
            assert filt.delete(part[-1]).all(), "keys to take out were not in the filter"
            if filt.insert(part[1]):
                blob = filt.table.tobytes()
        return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "filter": pa.array([blob], pa.binary())})

    number, filt, keys = None, None, {}
    for b in batches:
        for s, step, f, k1, k2 in zip(*(b.column(c).to_pylist() for c in ("shard", "step", "filter", "k1", "k2")), strict=True):
            if s != number:
                if number is not None:
                    yield done(number, filt, keys)
                number, filt, keys = s, None, {1: [], -1: []}
            if step == 0:
                filt = Cuckoo.of(f)
            else:
                keys[step].append(np.array([[k1, k2]]))
    if number is not None:
        yield done(number, filt, keys)


def _deal(bits: int, first: list[int], splits: list[int]):
    """References by piece: their shard's, or one of its pieces by the document where it has several."""
    first, splits = np.array(first, np.int64), np.array(splits, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, row in _held(batches):
            if not len(keys):
                continue
            shard = (keys[:, 0].view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            piece = first[shard] + np.mod(row, splits[shard])
            packed = list(pack(piece, [keys.copy(), ids, row]))
            yield _piece([p[0] for p in packed], 2, *zip(*(p[1] for p in packed), strict=True))

    return run


def _piece(piece: list[int], kind: int, a: list, b: list, c: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"piece": pa.array(piece, pa.int32()), "kind": pa.array([kind] * len(piece), pa.int32()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "c": pa.array(c, pa.binary())})


_PIECE = "piece int, kind int, a binary, b binary, c binary"


def _tables(first: list[int], splits: list[int]):
    """The exact table of each shard, its keys in order, for every piece of the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (k1, k2, top) in _by_shard(batches, ("k1", "k2", "top")):
            o = np.lexsort((k2, k1))
            for i in range(splits[shard]):
                yield _piece([first[shard] + i], 1, [np.stack([k1, k2], 1)[o].tobytes()], [top[o].astype(np.int64).tobytes()], [b""])

    return run


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece the references that have to go: filter first (kind 0), then the exact table (kind 1)."""
    number, filt, table = None, None, None
    for b in batches:
        for piece, kind, a, bb, c in zip(*(b.column(x).to_pylist() for x in ("piece", "kind", "a", "b", "c")), strict=True):
            if piece != number:
                number, filt, table = piece, None, None
            if kind == 0:
                filt = Cuckoo.of(a)
            elif kind == 1:
                keys = np.frombuffer(a, "<i8").reshape(-1, 2)
                table = keys[:, 0].copy(), keys[:, 1].copy(), np.frombuffer(bb, "<i8")
            elif filt is not None and table is not None:
                keys, ids, row = np.frombuffer(a, "<i8").reshape(-1, 2), np.frombuffer(bb, "<i8"), np.frombuffer(c, "<i8")
                at = np.flatnonzero(filt.has(keys))
                keys, ids, row = keys[at], ids[at], row[at]
                lo, hi = np.searchsorted(table[0], keys[:, 0], "left"), np.searchsorted(table[0], keys[:, 0], "right")
                gone, top = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
                while (lo < hi).any():  # nearly always one step: keys that share 64 bits are rare
                    on = np.flatnonzero(lo < hi)
                    hit = on[table[1][lo[on]] == keys[on, 1]]
                    gone[hit], top[hit] = True, table[2][lo[hit]]
                    lo[on] += 1
                at = np.flatnonzero(gone & (ids < top))
                if len(at):
                    whole = pa.py_buffer(keys[at].tobytes())
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[at], pa.int64(), mask=ids[at] == NONE), "row": row[at], "key": pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(at), [None, whole]).cast(pa.binary())})


def _remove(min_chars: int, keep_text: bool, rest: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, dropped, sha, text = [], [], [], []
            for t, keys in zip(_raw(b), b.column("gone_keys").to_pylist(), strict=True):
                lines.append(t.count(b"\n") + 1)
                kept, n = t, 0
                if keys:
                    gone, parts = set(keys), t.split(b"\n")
                    left = [x for x in parts if (k := line_key(x, min_chars)) is None or k not in gone]
                    kept, n = b"\n".join(left), len(parts) - len(left)
                dropped.append(n)
                sha.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    text.append(kept.decode("utf-8", "replace"))
            cols = [b.column(c) for c in rest] + [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(text, pa.string())] if keep_text else []), [*rest, "n_lines", "n_dropped", "kept_sha256", *(["kept"] if keep_text else [])])

    return run


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("row"))


class LineIndex:
    """The lines of the documents that were put in and not taken out again.

    A document is a doc_id with a text: rows that agree in both are one, rows that differ in either are two. A null text
    is empty. A document without a doc_id counts, and never is the largest. Lines that one document repeats count once.
    ``bits`` shards (a power of two) are chosen at the first insertion. One writer at a time; readers see whole versions.
    """

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = 3, min_chars: int = 20):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.s = {"version": 0, "bits": 0, "min_docs": min_docs, "min_chars": min_chars, "refs": [], "counts": [], "filters": None, "deleted": False}

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineIndex:
        """The last version that was written to a folder."""
        index = cls(spark, folder)
        index.s = spark.read.schema(_STATE).json(f"{index.folder}/state").orderBy(F.desc("version")).first().asDict()
        return index

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _commit(self, **changed) -> None:
        self.s |= changed | {"version": self.s["version"] + 1}
        self.spark.createDataFrame([tuple(self.s.values())], _STATE).coalesce(1).write.mode("append").json(f"{self.folder}/state")

    def refs(self) -> DataFrame:
        """``(doc_id, row, keys)`` of each document in the index."""
        all_rows = self.spark.read.schema("doc_id long, row long, keys binary, step int").parquet(*self.s["refs"])
        if not self.s["deleted"]:
            return all_rows.drop("step")
        live = all_rows.groupBy("doc_id", "row").agg(F.sum("step").alias("step"), F.max("keys").alias("keys"))
        return live.where("step > 0").drop("step")

    def counts(self) -> DataFrame:
        """``(k1, k2, n, top)``: documents that hold each key, and the largest doc_id among them."""
        runs = self.spark.read.schema("k1 long, k2 long, n long, top long").parquet(*self.s["counts"])
        return runs if len(self.s["counts"]) == 1 else runs.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def _shard(self) -> F.Column:
        return F.shiftrightunsigned("k1", 64 - self.s["bits"]).cast("int").alias("shard")

    def insert(self, docs: DataFrame) -> None:
        """Put documents in; those that are there already count once."""
        small_batches(self.spark)
        new = _named(docs).mapInArrow(_extract(self.s["min_chars"]), "doc_id long, row long, keys binary")
        if self.s["refs"]:
            there = self.refs().select(F.col("doc_id").alias("d"), F.col("row").alias("r"))
            new = new.join(there, F.col("row").eqNullSafe(F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_anti")
        path = self._write(new.withColumn("step", F.lit(1)), "refs")
        written = self.spark.read.schema("doc_id long, row long, keys binary, step int").parquet(path)
        if written.groupBy("doc_id", "row").count().where("count > 1").limit(1).count():
            once, path = path, self._write(written.dropDuplicates(["doc_id", "row"]), "refs")
            drop_path(self.spark, once)
            written = self.spark.read.schema(written.schema).parquet(path)
        run = written.mapInArrow(_combine, "k1 long, k2 long, n long, top long").groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
        added = self._write(run, "counts")
        if not self.s["bits"]:
            total = self.spark.read.parquet(added).agg(F.sum("n")).first()[0] or 0
            self.s["bits"] = min(MOST_BITS, max(LEAST_BITS, (total // SHARD_REFS).bit_length()))
        before = self.counts() if self.s["counts"] else None
        changed = {"refs": [*self.s["refs"], path], "counts": [*self.s["counts"], added]}
        steps = self._steps(before, self.spark.read.parquet(added)) if before is not None else None
        self.s |= changed
        if len(self.s["counts"]) > 8:  # runs are merged now and then, so that reading stays one pass over few files
            old, self.s["counts"] = self.s["counts"], [self._write(self.counts(), "counts")]
            drop_path(self.spark, *old)
            steps = None
        self._commit(filters=self._filters(steps))

    def delete(self, ids: DataFrame) -> None:
        """Take all documents of ``ids(doc_id)`` out: the index is as though they had never been put in."""
        out = self.refs().join(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
        path = self._write(out.withColumn("step", F.lit(-1)), "refs")
        taken = self.spark.read.schema("doc_id long, row long, keys binary, step int").parquet(path)
        minus = taken.mapInArrow(_combine, "k1 long, k2 long, n long, top long").groupBy("k1", "k2").agg((-F.sum("n")).alias("n"), F.max("top").alias("top"))
        minus, minus_path = materialize(minus, "line-minus")
        before = self.counts()
        steps, steps_path = materialize(self._steps(before, minus), "line-steps")
        # Keys that lost the largest document look for the next among those that are left.
        lost = before.join(minus.select("k1", "k2", F.col("top").alias("was")), ["k1", "k2"]).where("top = was").select("k1", "k2")
        self.s |= {"refs": [*self.s["refs"], path], "deleted": True}
        held = self.refs().mapInArrow(_combine, "k1 long, k2 long, n long, top long").join(lost, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.max("top").alias("next"))
        left = before.join(minus.select("k1", "k2", F.col("n").alias("less")), ["k1", "k2"], "left").join(lost.withColumn("lost", F.lit(True)), ["k1", "k2"], "left").join(held, ["k1", "k2"], "left")
        left = left.select("k1", "k2", (F.col("n") + F.coalesce("less", F.lit(0))).alias("n"), F.when(F.col("lost"), F.col("next")).otherwise(F.col("top")).alias("top")).where("n > 0")
        old, self.s["counts"] = self.s["counts"], [self._write(left, "counts")]
        self._commit(filters=self._filters(steps))
        drop_path(self.spark, minus_path, steps_path, *old)

    def _steps(self, before: DataFrame, delta: DataFrame) -> DataFrame:
        """Keys that come to ``min_docs`` documents (step 1) or fall below that (step -1)."""
        both = before.select("k1", "k2", "n", F.lit(0).alias("d")).union(delta.select("k1", "k2", F.lit(0), "n")).groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
        least = self.s["min_docs"]
        return both.select("k1", "k2", (F.when(F.expr(f"n + d >= {least}"), 1).otherwise(0) - F.when(F.expr(f"n >= {least}"), 1).otherwise(0)).alias("step")).where("step <> 0")

    def _active(self) -> DataFrame:
        return self.counts().where(f"n >= {self.s['min_docs']}")

    def _filters(self, steps: DataFrame | None) -> str:
        """The filters after ``steps``; None, and those that have no room, are built from the counts."""
        def build(keys: DataFrame) -> DataFrame:
            return keys.select(self._shard(), "k1", "k2").repartition("shard").sortWithinPartitions("shard").mapInArrow(_build, "shard int, filter binary")

        old = self.s["filters"]
        if steps is None or old is None:
            return self._write(build(self._active()), "filters")
        was = self.spark.read.schema("shard int, filter binary").parquet(old)
        rows = was.select("shard", F.lit(0).alias("step"), "filter", F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2")).union(steps.select(self._shard(), "step", F.lit(None).cast("binary"), "k1", "k2"))
        changed, path = materialize(rows.repartition("shard").sortWithinPartitions("shard", F.abs("step")).mapInArrow(_change, "shard int, filter binary"), "line-filters")
        full = changed.where("filter is null").select("shard")  # at most 4096
        again = build(self._active().join(F.broadcast(full.withColumnRenamed("shard", "s")), self._shard() == F.col("s"), "left_semi"))
        out = self._write(changed.where("filter is not null").union(again), "filters")
        drop_path(self.spark, path, old)
        return out

    def dropped(self) -> DataFrame:
        """``(doc_id, row, key)``: the lines' keys that each document loses."""
        shards = 1 << self.s["bits"]
        sizes = {r.shard: r.n for r in self.counts().groupBy(self._shard()).agg(F.sum("n").alias("n")).collect()}  # at most 4096
        share = max(1, sum(sizes.values()) // shards)
        splits = [max(1, -(-sizes.get(i, 0) // share)) for i in range(shards)]
        first = np.r_[0, np.cumsum(splits)[:-1]].tolist()
        filters = self.spark.read.schema("shard int, filter binary").parquet(self.s["filters"])

        def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s, f in zip(b.column("shard").to_pylist(), b.column("filter").to_pylist(), strict=True):
                    for i in range(splits[s]):
                        yield _piece([first[s] + i], 0, [f], [b""], [b""])

        exact = self._active().where("top is not null").select(self._shard(), "k1", "k2", "top").repartition("shard").sortWithinPartitions("shard")
        all_kinds = filters.mapInArrow(copies, _PIECE).union(exact.mapInArrow(_tables(first, splits), _PIECE)).union(self.refs().mapInArrow(_deal(self.s["bits"], first, splits), _PIECE))
        return all_kinds.repartition("piece").sortWithinPartitions("piece", "kind").mapInArrow(_probe, "doc_id long, row long, key binary")

    def apply(self, docs: DataFrame, keep_text: bool = False) -> tuple[DataFrame, str]:
        """``docs`` (all in the index) with n_lines, n_dropped, kept_sha256 and, if asked, the kept text instead of text;
        and the folder of the table that the result reads, to be dropped by the caller.

        Lines under ``min_chars`` code points, or held by fewer than ``min_docs`` documents, stay, as do all lines of
        the largest doc_id that holds them. Other columns pass; those named as the results are replaced. Documents of
        which all lines go are empty. Whole texts are worked on, one at a time.
        """
        gone, path = materialize(self.dropped().groupBy("doc_id", "row").agg(F.collect_list("key").alias("gone_keys")).select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row"), "gone_keys"), "line-gone")
        made = ["n_lines", "n_dropped", "kept_sha256", *(["kept"] if keep_text else [])]
        rest = [c for c in docs.columns if c not in (*made, "text")]
        text = F.coalesce("text", F.lit(""))
        rows = docs.select(*rest, text.alias("text"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("_row"))
        rows = rows.join(gone, (F.col("_row") == F.col("gone_row")) & F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id")), "left").select(*rest, "text", "gone_keys")
        small_batches(self.spark)
        kinds = {"n_lines": LongType(), "n_dropped": LongType()}
        schema = StructType([*(docs.schema[c] for c in rest), *(StructField(c, kinds.get(c, StringType())) for c in made)])
        return rows.mapInArrow(_remove(self.s["min_chars"], keep_text, rest), schema), path


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = LineIndex(spark, f"{shared_dir(spark)}/line-index-{uuid.uuid4().hex}")
    index.insert(docs)
    out, _ = index.apply(docs)
    drop_path(spark, index.folder)
    return out


SQL = r"""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM s),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM u),
c AS (SELECT k, max(doc_id) AS top FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, i, line, coalesce(k.doc_id < top, false) AS gone FROM k LEFT JOIN c USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""
