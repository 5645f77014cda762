"""Interval labels: for every node the earliest arrival as a function of the departure, with the path of each stretch.

Labels are corrected in rounds: functions that got lower go through the arcs of their node, and each node keeps the
lowest. FIFO arcs make that exact, so fastest profiles need no list of paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopath.functions.lowest import FUNCTION, lowest, through
from chronopath.functions.profiles import ARRIVAL, PIECES, walk
from chronopath.operators import envelopes as E
from chronopath.plans.materialize import checkpoint


def labels(edges: DataFrame, queries: DataFrame, budget: bool = True, border: bool = False) -> DataFrame:
    """``(query_id, node, fn)``: earliest arrivals of departures in [ts, te] from each query's source, within its budget
    or without one. With ``border`` the search ends where no open label lies under the destination's function, so other
    nodes' labels may be higher than they could be.

    A round is a join on the node and one shuffle by (query, node); only labels that changed take part.
    """
    q = queries.select("query_id", "src", "dst", F.col("ts").cast("double").alias("ts"), F.col("te").cast("double").alias("te"), F.col("b").cast("double").alias("b") if budget else F.lit(None).cast("double").alias("b"))
    limits = q.select("query_id", "b", "dst")
    piece = F.struct(F.col("ts").alias("s"), F.col("te").alias("e"), F.col("ts").alias("a0"), F.col("te").alias("a1"), F.array().cast("array<int>").alias("path"))
    best = checkpoint(q.select("query_id", F.col("src").alias("node"), F.array(piece).cast(FUNCTION).alias("fn"), F.lit(True).alias("new")))
    arcs = edges.where("u <> v").select(F.col("u").alias("_u"), "v", "arc_id", F.col("knots").alias("_k"))
    while best.where("new").limit(1).count():
        at = best.where("new").join(limits, "query_id").where("node <> dst" if border else "true")
        goal = best.join(limits.select("query_id", F.col("dst").alias("node")), ["query_id", "node"], "left_semi").select("query_id", F.col("fn").alias("border"))
        step = at.join(goal, "query_id", "left") if border else at.withColumn("border", F.lit(None).cast(FUNCTION))
        grown = step.join(arcs, F.col("node") == F.col("_u")).select("query_id", F.col("v").alias("node"), "fn", "b", "arc_id", "_k", "border").mapInArrow(through, f"query_id int, node int, fn {FUNCTION}").where("size(fn) > 0")
        both = best.select("query_id", "node", "fn", F.lit(True).alias("old")).unionByName(grown.withColumn("old", F.lit(False)))
        best = checkpoint(both.repartition("query_id", "node").sortWithinPartitions("query_id", "node", F.desc("old")).mapInArrow(lowest, f"query_id int, node int, fn {FUNCTION}, new boolean"))
    return best.drop("new")


def pieces(found: DataFrame) -> DataFrame:
    """Labels piece by piece: ``(query_id, node, s, e, a0, a1, path)``; an instant is a piece of its own where s = e."""
    return found.select("query_id", "node", F.explode("fn").alias("p")).select("query_id", "node", "p.*")


def arrivals_at(found: DataFrame, points: DataFrame) -> DataFrame:
    """``(query_id, node, t, arrival, path)`` at departures ``(query_id, t)``, by arrival, arcs, path."""
    at = F.col("t").cast("double")
    value = F.when(at <= F.col("s"), F.col("a0")).when(at >= F.col("e"), F.col("a1")).otherwise(F.col("a0") + F.try_divide((F.col("a1") - F.col("a0")) * (at - F.col("s")), F.col("e") - F.col("s")))
    hit = pieces(found).join(points, "query_id").where((F.col("s") <= at) & (at <= F.col("e"))).withColumn("arrival", value)
    return hit.groupBy("query_id", "node", "t").agg(F.min(F.struct(F.round("arrival", 9).alias("arrival"), F.size("path").alias("n"), "path")).alias("m")).select("query_id", "node", "t", "m.arrival", "m.path")


def exact_profiles(edges: DataFrame, queries: DataFrame, chosen: DataFrame) -> DataFrame:
    """Profiles of given paths ``(query_id, path)`` as ``paths.profiles`` has them, each walked as a whole."""
    knot = lambda c: F.struct(F.col(c).cast("double").alias("t"), F.col(c).cast("double").alias("v"))
    steps = chosen.select("query_id", "path", F.posexplode_outer("path").alias("i", "arc_id")).join(edges.select("arc_id", "v", "lb", "knots", "pieces"), "arc_id", "left")
    lists = steps.groupBy("query_id", "path").agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "v", "lb", "knots", "pieces")))).alias("_l"))
    rows = lists.join(queries, "query_id").select(
        "query_id", F.col("dst").alias("node"), "path", F.concat(F.array("src"), F.transform("_l", lambda x: x["v"])).alias("nodes"), F.aggregate("_l", F.lit(0.0), lambda s, x: s + x["lb"]).alias("cost"), F.array().cast("array<int>").alias("used"),
        F.when(F.col("ts") < F.col("te"), F.array(knot("ts"), knot("te"))).otherwise(F.array(knot("ts"))).alias("arrival"), F.array(F.struct(F.col("ts").cast("double").alias("t0"), F.col("te").cast("double").alias("t1"), F.lit(0).cast("long").alias("score"))).alias("pieces"),
        F.transform("_l", lambda x: x["knots"]).alias("_ks"), F.transform("_l", lambda x: x["pieces"]).alias("_ps"),
    )
    return rows.mapInArrow(walk, f"query_id int, node int, path array<int>, nodes array<int>, cost double, used array<int>, arrival {ARRIVAL}, pieces {PIECES}").drop("node", "used")


def all_fastest(edges: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fastest paths of every departure whatever the budget: segments ``(query_id, s, e, s_inc, e_inc, path)``, and the
    paths' profiles, whose scores are told afterwards."""
    found = labels(edges, queries, budget=False, border=True)
    chosen = pieces(found).join(queries.select("query_id", F.col("dst").alias("node")), ["query_id", "node"], "left_semi").select("query_id", "path").distinct()
    profiles = checkpoint(exact_profiles(edges, queries, chosen))
    free = queries.withColumn("b", F.lit(1e12))
    return E.envelope(profiles, free, fastest=True), profiles
