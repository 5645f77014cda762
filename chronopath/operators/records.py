"""Batch analytics over records: summaries, percentiles, paired tests, corrections, sessions, imputation, set checks.

Operators take DataFrames and column names; grouping keys are the only shuffle keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronopath.plans.materialize import checkpoint


def nearest_rank(value: str, p: float) -> Column:
    """The ceil(p * n)-th smallest value (null on no rows)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def interpolated(value: str, p: float) -> Column:
    return F.expr(f"percentile({value}, {p})")


def iqr(value: str) -> Column:
    return F.expr(f"percentile({value}, 0.75) - percentile({value}, 0.25)")


def cumulated(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """Distinct values of each group with ``w``, their weight (number of rows), ``upto``, that of all values up to them,
    and the group's ``total``. Rows without a value or weight are left out; null keys are a group.

    Values are dealt by ranges of (keys, value), so a group may spread over all tasks; a range starts at the sum of the
    group's ranges before it.
    """
    counted = df.withColumn("_w", F.lit(1) if weight is None else weight).where(F.col(value).isNotNull() & F.col("_w").isNotNull()).groupBy(*keys, value).agg(F.sum("_w").alias("w"))
    held = checkpoint(counted.repartitionByRange(*keys, value).withColumn("_p", F.spark_partition_id()))
    per = held.groupBy(*keys, "_p").agg(F.sum("w").alias("_n"))
    w = Window.partitionBy(*keys)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("_n").over(w)).drop("_n")
    own = held.withColumn("_c", F.sum("w").over(Window.partitionBy(*keys, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    right = per.select(F.col("_p").alias("_rp"), "_before", "total", *[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)])
    on = F.col("_p") == F.col("_rp")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_r{i}"))
    return own.join(right, on).select(*keys, value, "w", (F.col("_c") + F.col("_before")).alias("upto"), "total")


def percentiles(df: DataFrame, keys: list[str], value: str, ranks: dict[str, float] | None = None, between: dict[str, float] | None = None) -> DataFrame:
    """Exact percentiles of groups of any size, by name: ``ranks`` take the ceil(p n)-th smallest value (the smallest
    for 0), ``between`` interpolate at (n - 1) p. Groups without values have no row."""
    cum = cumulated(df, keys, value)
    at = lambda place: F.max(F.when((F.col("upto") - F.col("w") <= place) & (place < F.col("upto")), F.col(value)))
    part = lambda p: (F.col("total") - 1) * F.lit(float(p))
    found = [at(F.greatest(F.ceil(F.col("total") * F.lit(float(p))) - 1, F.lit(0))).alias(name) for name, p in (ranks or {}).items()]
    for name, p in (between or {}).items():
        found += [at(F.floor(part(p))).cast("double").alias(f"_lo_{name}"), at(F.ceil(part(p))).cast("double").alias(f"_hi_{name}"), F.max(part(p) - F.floor(part(p))).alias(f"_at_{name}")]
    out = cum.groupBy(*keys).agg(*found)
    lo, hi, share = (lambda n: F.col(f"_lo_{n}")), (lambda n: F.col(f"_hi_{n}")), (lambda n: F.col(f"_at_{n}"))
    return out.select(*keys, *(ranks or {}), *[(lo(n) + (hi(n) - lo(n)) * share(n)).alias(n) for n in between or {}])


def beside(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of ``other``, one row a key at most; null keys are a key."""
    right, on = other.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], *[c for c in other.columns if c not in keys]), F.lit(True)
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_o{i}"))
    return df.join(right, on, "left").drop(*[f"_o{i}" for i in range(len(keys))])


def weighted_percentile(df: DataFrame, keys: list[str], value: str, weight: str, p: float) -> DataFrame:
    """Least value whose cumulated weight reaches p of the total."""
    return cumulated(df, keys, value, F.col(weight)).where(F.col("upto") >= p * F.col("total")).groupBy(*keys).agg(F.min(value).alias("weighted_percentile"))


def two_level_median(df: DataFrame, keys: list[str], inner: str, value: str) -> DataFrame:
    """Median over groups of the medians of their inner groups (trials of a query, queries of a group)."""
    one = percentiles(df, [*keys, inner], value, between={"_m": 0.5})
    n = df.select(*keys, inner).distinct().groupBy(*keys).agg(F.count("*").alias("n_inner"))
    return beside(n, percentiles(one, keys, "_m", between={"median": 0.5}), keys).select(*keys, "median", "n_inner")


def summary(df: DataFrame, keys: list[str], value: str, ok: Column, limit: float) -> DataFrame:
    """Counts, success rate, and PAR-2 mean: failures count twice the limit."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(ok.cast("long")).alias("n_ok"), F.round(F.avg(ok.cast("double")), 6).alias("ok_rate"),
        F.round(F.avg(F.when(ok, F.col(value)).otherwise(2.0 * limit)), 6).alias("par2"), F.round(1.96 * F.stddev_samp(value) / F.sqrt(F.count(value)), 6).alias("ci_half"),
    )


def histogram(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    return df.groupBy(*keys, category).agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*keys)), 6))


def against_baseline(df: DataFrame, key: str, level: str, base, value: str) -> DataFrame:
    """Speed-up of each level over the baseline level of its key, and that per level unit."""
    b = df.where(F.col(level) == base).select(key, F.col(value).alias("_b"))
    return df.join(b, key).withColumn("speedup", F.round(F.col("_b") / F.col(value), 6)).withColumn("efficiency", F.round(F.col("_b") / F.col(value) / F.col(level), 6)).drop("_b")


def average_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Ranks with ties sharing their mean."""
    w = Window.partitionBy(*keys)
    r, n = F.rank().over(w.orderBy(value)), F.count("*").over(w.partitionBy(*keys, value) if not keys else Window.partitionBy(*keys, value))
    return df.withColumn("avg_rank", r + (n - 1) / 2)


def signed_rank(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Wilcoxon signed-rank of each group: n pairs that differ, W+, W-, rank-biserial effect, two-sided normal p-value.

    z = (min(W+, W-) - n(n+1)/4 + 1/2) / sqrt(n(n+1)(2n+1)/24): a continuity term, no correction of ties. Equal pairs are
    left out; a group of nothing else has no p and effect 0.
    """
    every = df.withColumn("_d", F.col(x) - F.col(y)).withColumn("_a", F.abs("_d"))
    r = average_rank(every.where("_d <> 0"), keys, "_a")
    s = r.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("avg_rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("_d") < 0, F.col("avg_rank")).otherwise(0.0)).alias("w_minus"))
    alike = every.groupBy(*keys).agg(F.count(F.when(F.col("_d") != 0, 1)).alias("_n")).where("_n = 0").select(*keys, F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("w_plus"), F.lit(0.0).alias("w_minus"))

    @F.udf("double", useArrow=True)
    def tail(z: float) -> float | None:  # one value a group: erfc has no SQL function
        return None if z is None else math.erfc(abs(z) / math.sqrt(2))

    n = F.col("n")
    z = F.try_divide(F.least("w_plus", "w_minus") - n * (n + 1) / 4.0 + 0.5, F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0))
    effect = F.coalesce(F.try_divide(F.col("w_plus") - F.col("w_minus"), F.col("w_plus") + F.col("w_minus")), F.lit(0.0))
    return s.unionByName(alike).withColumn("effect", F.round(effect, 6)).withColumn("z", z).withColumn("p", F.round(tail("z"), 6)).drop("z")


def holm(df: DataFrame, keys: list[str], p: str, order: str) -> DataFrame:
    """Holm's correction: running maximum of (m - rank + 1) * p, at most 1."""
    w = Window.partitionBy(*keys).orderBy(p, order)
    step = F.least(F.lit(1.0), (F.count("*").over(Window.partitionBy(*keys)) - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("_s", step).withColumn("holm", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def bootstrap_median(df: DataFrame, keys: list[str], value: str, order: str, draws: int = 1000, seed: int = 7, block: int = 250) -> DataFrame:
    """95 % interval of the median from ``draws`` resamples; draws depend on seed, draw and row alone.

    Each row gets a Poisson(1) count in each draw; a draw's median is the least value at which half its counts are
    reached. Rows are ranked by value and cut to blocks; each block's counts are summed by draw in the task that holds it,
    and only the block in which a draw reaches its half is gone through again, so neither rows nor values are held for
    all draws.
    """
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    rows = df.where(F.col(value).isNotNull()).select(*own, F.col(value).alias("_v"), F.col(order).alias("_o"))
    tasks = max(1, math.ceil(rows.count() * draws / 2e6))
    w = Window.partitionBy("_p", *ks).orderBy("_v", "_o")
    ranked = rows.repartitionByRange(tasks, *ks, "_v").withColumn("_p", F.spark_partition_id()).withColumn("_b", F.floor((F.row_number().over(w) - 1) / block))
    held = checkpoint(ranked.repartition(tasks, *ks, "_p", "_b"))
    u = F.expr(f"(shiftrightunsigned(xxhash64(_o, draw, {seed}), 11) + 0.5D) / 9007199254740992D")
    marks, total = [], 0.0
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        marks.append(total)
    count = F.lit(0)
    for m in marks:
        count = count + (F.col("_u") > m).cast("int")
    at = [*ks, "_p", "_b"]
    drawn = lambda x: x.withColumn("_u", u).withColumn("_n", count)
    n = drawn(held.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))).groupBy(*at, "draw").agg(F.sum("_n").alias("_n"))
    g = Window.partitionBy(*ks, "draw")
    n = n.withColumn("_upto", F.sum("_n").over(g.orderBy("_p", "_b"))).withColumn("_half", 0.5 * F.sum("_n").over(g))
    half = n.where((F.col("_upto") >= F.col("_half")) & (F.col("_upto") - F.col("_n") < F.col("_half")))
    half = half.select("draw", "_half", (F.col("_upto") - F.col("_n")).alias("_before"), *[F.col(c).alias("_at" + c) for c in at])
    same = F.lit(True)
    for c in at:
        same &= F.col(c).eqNullSafe(F.col("_at" + c))
    again = drawn(held.join(half, same)).where("_n > 0")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*ks, "draw").orderBy("_v", "_o").rowsBetween(Window.unboundedPreceding, 0))
    med = again.withColumn("_c", upto).where(F.col("_c") >= F.col("_half")).groupBy(*ks, "draw").agg(F.min("_v").alias("_m"))
    out = med.groupBy(*ks).agg(nearest_rank("_m", 0.025).alias("lo"), nearest_rank("_m", 0.975).alias("hi"))
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "lo", "hi")


def kaplan_meier_median(df: DataFrame, keys: list[str], time: str, event: str) -> DataFrame:
    """Least time at which the product of (1 - events / at risk) is a half or less; null where it stays above."""
    t = df.groupBy(*keys, time).agg(F.sum(F.col(event).cast("long")).alias("_d"), F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    risk = t.withColumn("_r", F.sum("_n").over(w))
    up = Window.partitionBy(*keys).orderBy(time)
    s = risk.withColumn("_s", F.sum(F.when(F.col("_d") == F.col("_r"), -1e9).otherwise(F.log(F.greatest(1 - F.col("_d") / F.col("_r"), F.lit(1e-300))))).over(up))
    return s.groupBy(*keys).agg(F.min(F.when(F.col("_s") <= math.log(0.5) + 1e-12, F.col(time))).alias("km_median"))


def time_bins(df: DataFrame, keys: list[str], ts: str, value: str, width: str = "15 minutes") -> DataFrame:
    """Tumbling bins with median and counts; values that aren't numbers count as missing."""
    x = df.select(*keys, F.window(ts, width).alias("_w"), F.col(value).try_cast("double").alias("_v")).select(*keys, F.col("_w.start").alias("bin_start"), "_v")
    n = x.groupBy(*keys, "bin_start").agg(F.count("*").alias("n"), F.count("_v").alias("n_valid"))
    return beside(n, percentiles(x, [*keys, "bin_start"], "_v", between={"median_value": 0.5}), [*keys, "bin_start"]).select(*keys, "bin_start", "median_value", "n", "n_valid")


def impute(df: DataFrame, value: str, levels: list[list[str]], default: Column) -> DataFrame:
    """Missing values from the median of ever wider groups, then a default; ``source`` tells which level served."""
    out, found = df, [F.when(F.col(value).isNotNull(), F.lit("direct"))]
    parts = [F.col(value)]
    for i, keys in enumerate(levels):
        med = percentiles(df, keys, value, between={f"_m{i}": 0.5})
        out = out.join(med, keys, "left")
        parts.append(F.col(f"_m{i}"))
        found.append(F.when(F.col(f"_m{i}").isNotNull(), F.lit(f"level{i + 1}")))
    out = out.withColumn("source", F.coalesce(*found, F.lit("default"))).withColumn("filled", F.coalesce(*parts, default))
    return out.drop(*[f"_m{i}" for i in range(len(levels))])


def fifo_repair(df: DataFrame, keys: list[str], t: str, v: str) -> DataFrame:
    """Running maximum of arrivals t + v: adds the repaired value and whether it changed."""
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_a", F.max(F.col(t) + F.col(v)).over(w)).withColumn("repaired", F.col("_a") - F.col(t)).withColumn("changed", F.col("_a") > F.col(t) + F.col(v)).drop("_a")


def sessions(df: DataFrame, keys: list[str], order: list[str], restarts: Column) -> DataFrame:
    """Number the runs of each key: a row for which ``restarts`` holds, or the first, begins one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce(restarts, F.lit(False)) | (F.row_number().over(w) == 1)
    return df.withColumn("_n", new.cast("int")).withColumn("session", F.sum("_n").over(w)).drop("_n")


def longest_run(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Longest stretch of consecutive integer positions; the earliest of equals."""
    w = Window.partitionBy(*keys).orderBy(position)
    runs = df.select(*keys, position).distinct().withColumn("_g", F.col(position) - F.row_number().over(w)).groupBy(*keys, "_g").agg(F.min(position).alias("first"), F.count("*").alias("length"))
    return runs.groupBy(*keys).agg(F.max_by(F.struct("first", "length"), F.struct("length", (-F.col("first")).alias("f"))).alias("m")).select(*keys, "m.first", "m.length")


def rank_quarters(df: DataFrame, keys: list[str], order: list[str], k: int = 4) -> DataFrame:
    """floor(k * rank / n) over ranks from 0: not ntile, whose first groups take the remainder."""
    w = Window.partitionBy(*keys)
    return df.withColumn("quarter", F.floor(k * (F.row_number().over(w.orderBy(*order)) - 1) / F.count("*").over(w)))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def best_two(df: DataFrame, keys: list[str], score: str, order: str, margin: float) -> DataFrame:
    """Best row of each key, the runner-up's score, and whether the two are within ``margin``."""
    r = top_k(df, keys, [F.col(score).desc(), F.col(order)], 2)
    return r.groupBy(*keys).agg(F.max(F.when(F.col("rank") == 1, F.col(order))).alias("best"), F.max(F.when(F.col("rank") == 1, F.col(score))).alias("best_score"), F.max(F.when(F.col("rank") == 2, F.col(score))).alias("second_score")).withColumn("ambiguous", F.coalesce(F.col("best_score") - F.col("second_score") < margin, F.lit(False)))


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first in order."""
    return top_k(df, keys, [F.col(c) for c in order], 1).drop("rank")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often: ``side`` is 'left' or 'right'."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def capped_distinct(df: DataFrame, keys: list[str], value: str, cap: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.least(F.lit(cap), F.count_distinct(value)).alias("n_distinct"))
