"""Shared pieces: folders that all executors see, materialised tables, packed buckets, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder from ``spark.checkpoint.dir``; where it is unset a temporary folder is set, on one machine only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="chronopath-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


BATCH_ROWS = 200
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of at most ``rows`` texts, for results that run later under the caller's session.

    Spark bounds batches by rows alone, so a worker holds ``rows`` times the length of the texts that stand together.
    """
    if int(spark.conf.get(_ROWS_KEY)) > rows or int(spark.conf.get(_ROWS_KEY)) <= 0:
        spark.conf.set(_ROWS_KEY, rows)


def few(rows: int, a_task: int, least: int = 8) -> int:
    """Tasks for so many rows, whatever the session's number of shuffle partitions is."""
    return max(least, rows // a_task + 1)


def materialize(df: DataFrame, name: str = "t", tasks: int | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and reread it: cuts lineage and survives lost executors.

    Arrow batches are small while it is written; the session's own setting comes back afterwards. ``tasks`` is an upper
    bound of tasks and files: tables of few rows need no more.
    """
    df = df.coalesce(tasks) if tasks else df
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_ROWS_KEY)
    small_batches(spark)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ROWS_KEY, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, *paths: str) -> None:
    """Delete tables written by ``materialize`` once nothing reads them any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Let the driver notice plans that nothing refers to any more, so that their shuffle files are deleted now."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Strings of a column; null counts as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


CHUNK = 1 << 18  # bytes or characters of text that are worked on at a time: arrays stay in the caches and workers small


def chunks(many: list, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of consecutive texts with about ``limit`` bytes or characters in all, one longer text alone."""
    i = 0
    while i < len(many):
        j, held = i, 0
        while j < len(many) and (j == i or held + len(many[j]) < limit):
            held += len(many[j]) + 1
            j += 1
        yield i, j
        i = j


def pack(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """Sort parallel arrays by bucket and yield each bucket's raw bytes, a few large rows instead of many small ones."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
    moved = [c[order] for c in columns]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[a]), [c[a:b].tobytes() for c in moved]


class Bounded(dict):
    """A memo that empties itself at ``limit`` entries, so that a worker's memory stays bounded."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def room(self, n: int) -> None:
        if len(self) + n > self.limit:
            self.clear()


def _is_star_forest(edges: DataFrame, tasks: int) -> bool:
    """Whether every larger node has one edge and no smaller node is a larger one as well: nothing is left to join."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).coalesce(tasks).where("up > 1 or (up = 1 and down = 1)").limit(1).count()


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the components that the edges (a, b) make."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[p], root[q])
        if (root[p] == low).all() and (root[q] == low).all():
            break
        for i in (root[p], root[q], p, q):
            np.minimum.at(root, i, low)
        while (root[root] != root).any():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``stars`` of a task's edges (u, v), a million of them at a time."""
    held: list[np.ndarray] = []

    def out():
        x = np.concatenate(held, axis=1)
        u, v = stars(x[0], x[1])
        return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    for b in batches:
        held.append(np.stack([np.asarray(b.column(c), dtype=np.int64) for c in ("u", "v")]))
        if sum(x.shape[1] for x in held) >= 1_000_000:
            yield out()
            held = []
    if held:
        yield out()


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of every node of ``edges(a, b)``: rows ``(node, component)``, component = smallest node reachable."""
    return components(edges)[0]


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """``connected_components`` and the folder of the one table that it reads, to be dropped by the caller.

    Every task first joins what its own edges join, which leaves a star for each of its components. Then large-star and
    small-star rounds alternate until all edges are stars. Each half round is a partial ``min`` and an equi-join (skewed
    hubs are split by adaptive execution); every round is written to the shared folder. Nulls and self loops are
    ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    cur = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    # Fewer tasks than the shuffle has join more each; they read in bounded chunks.
    cur = cur.coalesce(max(8, shuffle_parts(spark) // 8)).mapInArrow(_stars, "u long, v long").distinct()
    cur, path = materialize(cur, "cc", max(8, shuffle_parts(spark) // 8))
    # The rounds make many small stages: their tasks follow the number of edges, which never grows.
    tasks = few(cur.count(), 100_000)
    while not _is_star_forest(cur, tasks):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(tasks)
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        # Small star over the rows (u larger, v smaller): all smaller neighbours and u itself move to the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = moved.union(low.select("u", F.col("m").alias("v"))).distinct()
        nxt, new_path = materialize(nxt, "cc", tasks)
        drop_path(spark, path)
        cur, path = nxt, new_path
    both = cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return both, path
