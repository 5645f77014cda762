"""Streams of observations: collecting without duplicates, tumbling bins, and a best-so-far table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def observations(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """Files that land in a folder, each read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(folder)


def collect_once(stream: DataFrame, keys: list[str], ts: str, delay: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append each key's first observation within the watermark; the key index is the stream's state."""
    kept = stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    return kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def tumbling(stream: DataFrame, keys: list[str], ts: str, value: str, width: str, delay: str) -> DataFrame:
    """Bins with counts and an approximate median (an exact one can't be kept up incrementally)."""
    v = F.col(value).try_cast("double")
    binned = stream.withWatermark(ts, delay).groupBy(*keys, F.window(ts, width).alias("w"))
    return binned.agg(F.percentile_approx(v, 0.5, 10_000).alias("median_value"), F.count("*").alias("n"), F.count(v).alias("n_valid")).select(*keys, F.col("w.start").alias("bin_start"), "median_value", "n", "n_valid")


def write_bins(bins: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return bins.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def best_so_far(stream: DataFrame, keys: list[str], score: str, ties: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """A table of each key's best complete row so far, replaced batch by batch: readers always see a finished version.

    Version n is the folder ``out/v=n``; a batch that is run again after a failure writes the same version.
    """
    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if n:
            rows = spark.read.schema(batch.schema).parquet(f"{out}/v={n - 1}").unionByName(batch)
        names = batch.columns
        order = F.struct((-F.col(score)).alias("a"), *ties)
        best = rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in names if c not in keys]), order).alias("m"))
        best.select(*keys, "m.*").select(*names).write.mode("overwrite").parquet(f"{out}/v={n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_frontier(stream: DataFrame, key: str, value: str, cost: str, k: int, out: str, checkpoint: str) -> StreamingQuery:
    """Keep each key's undominated (value up, cost down) pairs, at most k, as keyed state; emits the frontier on change."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(name, frames, state: GroupState):
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            held += list(zip(f[value].astype(float), f[cost].astype(float), strict=True))
        front, least = [], float("inf")
        for v, c in sorted(set(held), key=lambda p: (-p[0], p[1])):
            if c < least:
                front.append((v, c))
                least = c
        front = front[:k]
        state.update(([p[0] for p in front], [p[1] for p in front]))
        yield pd.DataFrame({key: [name[0]] * len(front), value: [p[0] for p in front], cost: [p[1] for p in front]})

    kind = dict(stream.dtypes)[key]
    rows = stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {value} double, {cost} double", "vs array<double>, cs array<double>", "update", GroupStateTimeout.NoTimeout)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return rows.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
