"""Gates of a graph's payload: each check counts the rows it has seen and those that fail, and names the first of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopath.functions import temporal as T

GATES = ("arc_ids", "functions", "endpoints", "base_times", "two_knots", "minutes_rise", "travel_positive", "fifo", "support", "score_order", "score_contiguous", "score_range", "score_support")


def _gate(name: str, failed: Column) -> Column:
    return F.struct(F.lit(name).alias("gate"), F.coalesce(failed, F.lit(True)).alias("failed"))


def payload(static: DataFrame, functions: DataFrame, scores: DataFrame, support_end: float, cap: int) -> DataFrame:
    """``(gate, checked, failed, first_bad)`` of the payload of a graph, one row for each of GATES.

    ``static(arc_id, u, v, base)``, ``functions(arc_id, u, v, base, knots)``, ``scores(arc_id, pieces)``. Arc ids are 0,
    1, … without gaps, each once; every arc has one function, with its ends and base time, at least two knots, rising
    minutes from 0 to the support's end, positive times and no overtaking. Score pieces follow each other without gaps
    or overlap inside the support, with scores from 0 to ``cap``; arcs without pieces score nothing, which is allowed.
    Null values fail. Rows meet by arc id; all gates are one pass and one aggregation.
    """
    ids = static.groupBy("arc_id").agg(F.count("*").alias("_n"), F.first("u").alias("u"), F.first("v").alias("v"), F.first("base").alias("base"))
    n = ids.count()
    f = functions.groupBy("arc_id").agg(F.count("*").alias("_fn"), *[F.first(c).alias("f_" + c) for c in ("u", "v", "base", "knots")])
    p = scores.groupBy("arc_id").agg(F.count("*").alias("_pn"), F.first("pieces").alias("pieces"))
    x = ids.join(f, "arc_id", "full").join(p, "arc_id", "full")
    k, has, some = F.col("f_knots"), F.col("_fn").isNotNull(), F.col("pieces").isNotNull()
    steps = T.segments(k)
    pairs = F.zip_with(F.slice("pieces", F.lit(1), F.greatest(F.size("pieces") - 1, F.lit(0))), F.slice("pieces", F.lit(2), F.greatest(F.size("pieces") - 1, F.lit(0))), lambda a, b: F.struct(a["t1"].alias("end"), b["t0"].alias("start")))
    first, last = F.get(k, F.lit(0)), F.get(k, F.size(k) - 1)
    gates = [
        _gate("arc_ids", F.coalesce(F.col("_n"), F.lit(0)) != 1) if n == 0 else _gate("arc_ids", (F.coalesce(F.col("_n"), F.lit(0)) != 1) | (F.col("arc_id") < 0) | (F.col("arc_id") >= n)),
        _gate("functions", F.coalesce(F.col("_fn"), F.lit(0)) != 1),
        _gate("endpoints", ~((F.col("u") == F.col("f_u")) & (F.col("v") == F.col("f_v")))),
        _gate("base_times", ~(F.col("base") == F.col("f_base"))),
        _gate("two_knots", ~(has & (F.size(k) >= 2))),
        _gate("minutes_rise", ~(has & F.forall(steps, lambda s: s["t0"] < s["t1"]))),
        _gate("travel_positive", ~(has & F.forall(k, lambda q: q["v"] > 0))),
        _gate("fifo", ~(has & T.is_fifo(k))),
        _gate("support", ~(has & (first["t"] == 0) & (last["t"] == support_end))),
        _gate("score_order", some & ~F.forall("pieces", lambda q: q["t0"] < q["t1"])),
        _gate("score_contiguous", some & ((F.col("_pn") != 1) | ~F.forall(pairs, lambda q: q["end"] == q["start"]))),
        _gate("score_range", some & ~F.forall("pieces", lambda q: (q["score"] >= 0) & (q["score"] <= cap))),
        _gate("score_support", some & ~F.forall("pieces", lambda q: (q["t0"] >= 0) & (q["t1"] <= support_end))),
    ]
    rows = x.select("arc_id", F.explode(F.array(*gates)).alias("g")).groupBy("g.gate").agg(F.count("*").alias("checked"), F.sum(F.col("g.failed").cast("long")).alias("failed"), F.min(F.when(F.col("g.failed"), F.col("arc_id"))).cast("long").alias("first_bad"))
    names = x.sparkSession.createDataFrame([(g,) for g in GATES], "gate string")
    return names.join(rows, "gate", "left").na.fill(0, ["checked", "failed"])


def require(gates: DataFrame) -> None:
    """Raise on the first gate that failed, by the gates' order."""
    bad = {r.gate: r for r in gates.where("failed > 0").collect()}  # at most as many as there are gates
    for g in GATES:
        if g in bad:
            raise ValueError(f"{g}: {bad[g].failed} of {bad[g].checked} arcs fail, the first is {bad[g].first_bad}")
