"""Temporal stitch: a profile to an anchor arc, the arc, and a profile from its head become one profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopath.functions import temporal as T


def _end(knots, last: bool):
    return F.get(knots, F.size(knots) - 1 if last else F.lit(0))


def _same_path_simple():
    """No node twice over left, the arc and right; both sides carry their nodes, ends included."""
    return F.size(F.array_distinct(F.concat("nodes", "r_nodes"))) == F.size("nodes") + F.size("r_nodes")


def stitch(left: DataFrame, arcs: DataFrame, right: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(query_id, path, nodes, s, e, arrival, pieces, pivots)``: one row for each stretch of departures within budget.

    ``left`` and ``right`` are rows ``(query_id, path, nodes, arrival, pieces, pivots)``: nodes with both ends, arrival
    as knots over the departures at the first node, score pieces over the same, pivots the anchor arcs used.
    ``arcs(arc_id, u, v, knots, pieces)``; ``budgets(query_id, b)``. Left must end where the arc begins and right begin
    where it ends; a node that comes twice, or a loop as arc, gives nothing. The departures are those whose entry of
    the arc and of the right part lie in their domains and whose whole travel time is at most b. All in expressions.
    """
    l = left.withColumn("_u", F.element_at("nodes", -1))
    r = right.select("query_id", F.get("nodes", F.lit(0)).alias("_v"), *[F.col(c).alias("r_" + c) for c in ("path", "nodes", "arrival", "pieces", "pivots")])
    a = arcs.where("u <> v").select(F.col("u").alias("_u"), F.col("v").alias("_v"), "arc_id", F.col("knots").alias("_k"), F.col("pieces").alias("_p"))
    j = l.join(a, "_u").join(r, ["query_id", "_v"]).where(_same_path_simple()).join(budgets, "query_id")
    # Departures whose arrival at the arc lies in its domain, then those whose arrival at its head lies in right's.
    j = j.withColumn("_d", T.preimage(F.col("arrival"), _end(F.col("_k"), False)["t"], _end(F.col("_k"), True)["t"])).where("_d is not null")
    j = j.withColumn("_in", T.restrict(F.col("arrival"), F.col("_d.s"), F.col("_d.e")))
    j = j.withColumn("_mid", T.compose(T.to_arrival(F.col("_k")), F.col("_in")))
    j = j.withColumn("_d", T.preimage(F.col("_mid"), _end(F.col("r_arrival"), False)["t"], _end(F.col("r_arrival"), True)["t"])).where("_d is not null")
    j = j.withColumn("_mid", T.restrict(F.col("_mid"), F.col("_d.s"), F.col("_d.e"))).withColumn("_all", T.compose(F.col("r_arrival"), F.col("_mid")))
    j = j.withColumn("_ok", F.explode(T.joined(T.travel_at_most(F.col("_all"), F.col("b").cast("double")))))
    s, e = F.col("_ok.s"), F.col("_ok.e")
    part = lambda f: T.restrict(F.col(f), s, e)
    wide = F.col("_ok.s") < F.col("_ok.e")
    scores = T.score_add(T.score_add(T.score_restrict(F.col("pieces"), s, e), T.score_compose(F.col("_p"), part("_in"))), T.score_compose(F.col("r_pieces"), part("_mid")))
    point = F.array(F.struct(s.alias("t0"), e.alias("t1"), (T.score_at(F.col("pieces"), s) + T.score_at(F.col("_p"), T.value_at(F.col("_in"), s)) + T.score_at(F.col("r_pieces"), T.value_at(F.col("_mid"), s))).alias("score")))
    return j.select(
        "query_id", F.concat("path", F.array("arc_id"), "r_path").alias("path"), F.concat("nodes", "r_nodes").alias("nodes"), s.alias("s"), e.alias("e"), part("_all").alias("arrival"),
        F.when(wide, scores).otherwise(point).alias("pieces"), F.array_sort(F.array_union(F.array_union("pivots", "r_pivots"), F.array("arc_id"))).alias("pivots"),
    )
