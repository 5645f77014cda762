"""Frontiers that grow: candidates are added to kept pieces, and only the stretches of time that they touch are redone.

A frontier is a relation of pieces ``(query_id, path, n_edges, s, e, a0, a1, score)`` as in ``envelopes``: what each query
keeps after dominance and retention in every temporal cell. Adding is the same as compressing kept and new together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from chronopath.operators import envelopes as E
from chronopath.plans.materialize import checkpoint

COLUMNS = ["query_id", "path", "n_edges", "s", "e", "a0", "a1", "score"]


def _at(t):
    return F.when(F.col("s") == F.col("e"), F.col("a0")).otherwise(F.col("a0") + F.try_divide((F.col("a1") - F.col("a0")) * (t - F.col("s")), F.col("e") - F.col("s")))


def _clip(parts: DataFrame, lo, hi) -> DataFrame:
    """Parts cut to [lo, hi]; an instant stays only if it was one or the whole stretch is one."""
    s, e = F.greatest(F.col("s"), lo), F.least(F.col("e"), hi)
    cut = parts.withColumn("_s", s).withColumn("_e", e).where((F.col("_s") < F.col("_e")) | ((F.col("_s") == F.col("_e")) & ((F.col("s") == F.col("e")) | (lo == hi))))
    return cut.withColumn("_a0", _at(F.col("_s"))).withColumn("_a1", _at(F.col("_e"))).select("query_id", "path", "n_edges", F.col("_s").alias("s"), F.col("_e").alias("e"), F.col("_a0").alias("a0"), F.col("_a1").alias("a1"), "score", *[c for c in parts.columns if c not in COLUMNS])


def _stretches(new: DataFrame) -> DataFrame:
    """Disjoint closed stretches ``(query_id, lo, hi)`` that new pieces touch."""
    w = Window.partitionBy("query_id").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = new.select("query_id", "s", "e").distinct().withColumn("_n", F.coalesce(F.col("s") > before, F.lit(True)).cast("int")).withColumn("_run", F.sum("_n").over(w))
    return runs.groupBy("query_id", "_run").agg(F.min("s").alias("lo"), F.max("e").alias("hi")).drop("_run")


def joined(parts: DataFrame) -> DataFrame:
    """Neighbouring pieces of a path on one line and with one score as one, so that old cuts go."""
    w = Window.partitionBy("query_id", "path").orderBy("s", "e")
    slope = F.when(F.col("s") < F.col("e"), F.round((F.col("a1") - F.col("a0")) / (F.col("e") - F.col("s")), 6))
    same = (F.lag("e").over(w) == F.col("s")) & (F.lag("score").over(w) == F.col("score")) & (F.round(F.lag("a1").over(w), 9) == F.round("a0", 9)) & (F.lag(slope).over(w) == slope)
    runs = parts.withColumn("_n", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("_run", F.sum("_n").over(w))
    out = runs.groupBy("query_id", "path", "n_edges", "score", "_run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("a0", "s").alias("a0"), F.max_by("a1", "e").alias("a1"))
    # An instant inside or at the end of a longer piece of its path with the same value adds nothing.
    long = out.where("s < e").select("query_id", "path", "score", F.col("s").alias("_s"), F.col("e").alias("_e"))
    points = out.where("s = e").join(long, (out["query_id"] == long["query_id"]) & (out["path"] == long["path"]) & (out["score"] == long["score"]) & (F.col("s") >= F.col("_s")) & (F.col("s") <= F.col("_e")), "left_anti")
    return out.where("s < e").unionByName(points).select(*COLUMNS)


def kept_pieces(parts: DataFrame, spans: DataFrame, budgets: DataFrame, k: int) -> DataFrame:
    """Pieces of ``parts`` (with ``coverage``) that dominance and retention of k leave in the cells of ``spans(query_id, lo, hi)``."""
    wide = spans.select("query_id", F.col("lo").alias("ts"), F.col("hi").alias("te"))
    grid = E.cells(parts.drop("coverage"), wide)
    # Stretches of one query stand apart: a cell between two of them is none.
    grid = grid.join(spans.select("query_id", F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), "query_id").where((F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))).select("query_id", "lo", "hi")
    covered = E.undominated(E.in_cells(parts.drop("coverage"), grid))
    total = parts.select("query_id", "path", "coverage").distinct()
    ranked = E.cell_integrals(covered, budgets).drop("coverage").join(total, ["query_id", "path"])
    cells = checkpoint(E.retain(ranked, k).select("query_id", "lo", "hi", "path", "n_edges", F.col("score").alias("c_score"), "travel_lo", "travel_hi"))
    return cells.select("query_id", "path", "n_edges", F.col("lo").alias("s"), F.col("hi").alias("e"), (F.col("lo") + F.col("travel_lo")).alias("a0"), (F.col("hi") + F.col("travel_hi")).alias("a1"), F.col("c_score").alias("score"))


def insert(kept: DataFrame, new: DataFrame, budgets: DataFrame, k: int) -> DataFrame:
    """The frontier ``kept`` after the pieces ``new`` came in; ``budgets(query_id, b)``.

    Queries without new pieces, and kept pieces outside the stretches that new ones touch, pass as they are. How widely
    a path covers counts all its kept and new pieces. No new pieces change nothing; equal pieces count once.
    """
    new = new.select(*COLUMNS).distinct()
    spans = checkpoint(_stretches(new))
    both = kept.select(*COLUMNS).unionByName(new).distinct()
    coverage = both.join(spans.select("query_id").distinct(), "query_id", "left_semi").groupBy("query_id", "path").agg(F.sum(F.col("e") - F.col("s")).alias("coverage"))
    inside = _clip(both.join(spans, "query_id").where((F.col("s") <= F.col("hi")) & (F.col("lo") <= F.col("e"))), F.col("lo"), F.col("hi")).join(coverage, ["query_id", "path"]).drop("lo", "hi")
    redone = kept_pieces(checkpoint(inside), spans, budgets, k)
    w = Window.partitionBy("query_id").orderBy("lo")
    gaps = spans.withColumn("_next", F.lead("lo").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    far = F.lit(float("inf"))
    gaps = gaps.select("query_id", F.explode(F.array(F.when(F.col("_first"), F.struct((-far).alias("lo"), F.col("lo").alias("hi"))), F.struct(F.col("hi").alias("lo"), F.coalesce("_next", far).alias("hi")))).alias("g")).where("g is not null").select("query_id", "g.lo", "g.hi")
    touched = kept.select(*COLUMNS).join(gaps, "query_id")
    outside = _clip(touched.where("s < e and s < hi and lo < e"), F.col("lo"), F.col("hi")).unionByName(touched.where("s = e and s < hi and lo < s")).select(*COLUMNS)
    untouched = kept.select(*COLUMNS).join(spans.select("query_id").distinct(), "query_id", "left_anti")
    return joined(outside.unionByName(redone)).unionByName(untouched)


def running(stream: DataFrame, budgets: DataFrame, k: int, out: str, checkpoint_dir: str, shards: int = 64) -> StreamingQuery:
    """A frontier table kept up by a stream of pieces: ``out/v=n`` after batch n, in ``shards`` by query.

    Only shards of queries that a batch names are written anew, the others are read from the version that has them
    (``out/at`` tells which). A batch that runs again after a failure writes the same version.
    """
    kind = "query_id int, path array<int>, n_edges int, s double, e double, a0 double, a1 double, score bigint"

    def put(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch = checkpoint(batch.select(*COLUMNS).withColumn("shard", F.pmod(F.hash("query_id"), F.lit(shards))))
        named = [r.shard for r in batch.select("shard").distinct().collect()]  # at most ``shards``
        at = _where(spark, out, n - 1)
        old = _read(spark, out, {s: at[s] for s in named if s in at}, kind)
        insert(old, batch.drop("shard"), budgets, k).withColumn("shard", F.pmod(F.hash("query_id"), F.lit(shards))).write.mode("overwrite").partitionBy("shard").parquet(f"{out}/v={n}")
        rows = [(s, v) for s, v in (at | dict.fromkeys(named, n)).items()]
        spark.createDataFrame(rows, "shard int, v long").coalesce(1).write.mode("overwrite").parquet(f"{out}/at/n={n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def _where(spark, out: str, n: int) -> dict[int, int]:
    return {r.shard: r.v for r in spark.read.parquet(f"{out}/at/n={n}").collect()} if n >= 0 else {}


def _read(spark, out: str, at: dict[int, int], kind: str) -> DataFrame:
    """Shards from the versions that hold them; a shard that kept nothing has no files."""
    df = spark.createDataFrame([], kind)
    for v in sorted(set(at.values())):
        shards = [s for s, x in at.items() if x == v]
        df = df.unionByName(spark.read.schema(f"{kind}, shard int").parquet(f"{out}/v={v}").where(F.col("shard").isin(shards)).drop("shard"))
    return df


def frontier(spark, out: str, n: int) -> DataFrame:
    """The table that ``running`` keeps, after batch n."""
    return _read(spark, out, _where(spark, out, n), "query_id int, path array<int>, n_edges int, s double, e double, a0 double, a1 double, score bigint")
