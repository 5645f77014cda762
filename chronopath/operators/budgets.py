"""Budgets of profile queries from their fastest profiles, and how many anchors a budget leaves in the corridor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopath.operators import interval_labels as L
from chronopath.plans.materialize import checkpoint

DECIMAL = "decimal(28,14)"


def _up(x: Column) -> Column:
    """To the next billionth."""
    return F.ceil(x * 1_000_000_000).cast("decimal(28,0)").cast("double") / 1e9


def scaled(fastest: Column, slack: float) -> Column:
    return _up(fastest.cast(DECIMAL) * F.lit(str(1 + slack)).cast("decimal(10,6)"))


def fastest_range(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, least, most)``: least and largest fastest travel time over [ts, te], whatever the budget; null where
    some departure of the window reaches no destination."""
    found = L.labels(edges, queries, budget=False, border=True)
    ends = L.pieces(found).join(queries.select("query_id", F.col("dst").alias("node"), "ts", "te"), ["query_id", "node"])
    own = ends.groupBy("query_id", "ts", "te").agg(F.min(F.least(F.col("a0") - F.col("s"), F.col("a1") - F.col("e"))).alias("least"), F.max(F.greatest(F.col("a0") - F.col("s"), F.col("a1") - F.col("e"))).alias("most"), F.sum(F.col("e") - F.col("s")).alias("_w"))
    whole = F.col("_w") >= F.col("te") - F.col("ts") - 1e-9
    kept = own.select("query_id", *[F.when(whole, F.round(c, 12)).alias(c) for c in ("least", "most")])
    return queries.select("query_id").join(kept, "query_id", "left")


def variants(ranges: DataFrame, slack: float, tight_slack: float) -> DataFrame:
    """Two budgets of each ``(query_id, least, most)``: ``(query_id, variant, budget, full, mixed)``.

    MAIN is the largest fastest time with slack: every departure is feasible. TIGHT is the least fastest time with its
    slack where that lies between the two, else a quarter of the way from least to largest, so that some departures are
    feasible and some not; where both times are equal it is the least with slack. Queries without a range have neither.
    """
    least, most = F.col("least"), F.col("most")
    candidate = scaled(least, tight_slack)
    quarter = _up(least.cast(DECIMAL) + (most.cast(DECIMAL) - least.cast(DECIMAL)) / 4)
    tight = F.when((least < candidate) & (candidate < most), candidate).when(least < most, quarter).otherwise(candidate)
    both = ranges.where("least is not null").select("query_id", "least", "most", F.explode(F.array(F.struct(F.lit("MAIN").alias("variant"), scaled(most, slack).alias("budget")), F.struct(F.lit("TIGHT").alias("variant"), tight.alias("budget")))).alias("x"))
    budget = F.col("x.budget")
    return both.select("query_id", "x.variant", budget.alias("budget"), (budget >= most).alias("full"), ((least < most) & (least <= budget) & (budget < most)).alias("mixed"))


def anchor_counts(edges: DataFrame, scores: DataFrame, bounds: DataFrame, windows: DataFrame) -> DataFrame:
    """``(query_id, variant, anchors)`` of ``windows(query_id, variant, ts, te, budget)``: arcs with a score within
    [ts, te + budget] that lie on a walk of at most the budget by lower bounds.

    ``bounds(query_id, node, from_src, to_dst)`` must reach as far as the largest budget. Windows without anchors count 0.
    """
    arcs = scores.where("score > 0").groupBy("arc_id").agg(F.collect_list(F.struct(F.col("t0").cast("double").alias("t0"), F.col("t1").cast("double").alias("t1"))).alias("on")).join(edges.select("arc_id", "u", "v", "lb"), "arc_id")
    a, z = bounds.select("query_id", F.col("node").alias("u"), "from_src"), bounds.select("query_id", F.col("node").alias("v"), "to_dst")
    on_way = arcs.join(a, "u").join(z, ["query_id", "v"]).withColumn("least", F.col("from_src") + F.col("lb") + F.col("to_dst"))
    hit = on_way.join(windows, "query_id").where((F.round("least", 12) <= F.col("budget")) & F.exists("on", lambda x: (x["t0"] <= F.col("te") + F.col("budget")) & (x["t1"] > F.col("ts"))))
    return windows.select("query_id", "variant").join(hit.groupBy("query_id", "variant").agg(F.count("*").alias("anchors")), ["query_id", "variant"], "left").na.fill(0, ["anchors"])


def with_budgets(edges: DataFrame, queries: DataFrame, slack: float = 0.25, tight_slack: float = 0.1) -> DataFrame:
    """``queries`` twice, with their main and tight budgets as ``b`` and the flags of ``variants``."""
    v = checkpoint(variants(fastest_range(edges, queries), slack, tight_slack))
    return queries.drop("b").join(v, "query_id").withColumnRenamed("budget", "b")
