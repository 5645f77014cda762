"""Path search over temporal graphs, for many queries at once: every search is joins between rows of queries and arcs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopath.functions import temporal as T
from chronopath.functions.profiles import ARRIVAL, PIECES, grow
from chronopath.operators import cells as C
from chronopath.plans.materialize import checkpoint


def lower_bounds(edges: DataFrame, starts: DataFrame, forward: bool = True, cells: DataFrame | None = None, without: DataFrame | None = None) -> DataFrame:
    """Least static cost to (or from, not ``forward``) every node that ``starts(query_id, node, b)`` reaches within b.

    Rows ``(query_id, node, cost, hops, arc_id)``; ties by hops, then by the last arc. Settled cell by cell
    (``cells.spread``, with its ``cells`` and ``without``); walking the last arcs back gives the way.
    """
    first = starts.select("query_id", "node", F.lit(0.0).alias("cost"), F.col("b").alias("limit"))
    return C.spread(edges, first, ["query_id"], "least", forward, cells, without).withColumn("node", F.col("node").cast(dict(edges.dtypes)["u"]))


def both_bounds(edges: DataFrame, queries: DataFrame, cells: DataFrame | None = None, without: DataFrame | None = None) -> DataFrame:
    """``(query_id, node, from_src, to_dst)`` of nodes that lie on some walk within budget."""
    fwd = lower_bounds(edges, queries.select("query_id", F.col("src").alias("node"), "b"), True, cells, without)
    rev = lower_bounds(edges, queries.select("query_id", F.col("dst").alias("node"), "b"), False, cells, without)
    return fwd.select("query_id", "node", F.col("cost").alias("from_src")).join(rev.select("query_id", "node", F.col("cost").alias("to_dst")), ["query_id", "node"])


def corridor(edges: DataFrame, queries: DataFrame, bounds: DataFrame) -> DataFrame:
    """``(query_id, arc_id, slack)`` of arcs with from_src(u) + lb + to_dst(v) <= budget."""
    out = bounds.select("query_id", F.col("node").alias("u"), "from_src")
    into = bounds.select("query_id", F.col("node").alias("v"), "to_dst")
    j = edges.select("arc_id", "u", "v", "lb").where("u <> v").join(out, "u").join(into, ["query_id", "v"]).join(queries.select("query_id", "b"), "query_id")
    return j.withColumn("slack", F.col("b") - F.col("from_src") - F.col("lb") - F.col("to_dst")).where("slack >= 0").select("query_id", "arc_id", "slack")


def horizon_ok(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, status)``: OUT_OF_HORIZON where [ts, te + b] leaves the common support of all arcs."""
    support = edges.agg(F.max(F.get("knots", F.lit(0))["t"]).alias("lo"), F.min(F.element_at("knots", -1)["t"]).alias("hi"))
    return queries.crossJoin(F.broadcast(support)).select("query_id", F.when((F.col("ts") >= F.col("lo")) & (F.col("te") + F.col("b") <= F.col("hi")), "OK").otherwise("OUT_OF_HORIZON").alias("status"))


def profiles(edges: DataFrame, queries: DataFrame, bounds: DataFrame | None = None, max_arcs: int | None = None) -> DataFrame:
    """All loopless paths of each query within its budget by lower bounds, with exact profiles.

    Rows ``(query_id, path, nodes, cost, arrival, pieces)``: arrival as knots over [ts, te], scores collected so far as
    pieces. A round extends every open path by one arc: the arc's travel function is composed with the arrival and its
    score, at entry time, is added. Source = destination gives the empty path.
    """
    bounds = both_bounds(edges, queries) if bounds is None else bounds
    q = queries.where("src <> dst").select("query_id", "src", "dst", "ts", "te", "b")
    knot = lambda c: F.struct(F.col(c).cast("double").alias("t"), F.col(c).cast("double").alias("v"))
    start = queries.select(
        "query_id", F.col("src").alias("node"), "dst", "b", F.array().cast("array<int>").alias("path"), F.array("src").alias("nodes"), F.lit(0.0).alias("cost"),
        F.when(F.col("ts") < F.col("te"), F.array(knot("ts"), knot("te"))).otherwise(F.array(knot("ts"))).alias("arrival"),
        F.array(F.struct(F.col("ts").cast("double").alias("t0"), F.col("te").cast("double").alias("t1"), F.lit(0).cast("long").alias("score"))).alias("pieces"),
    )
    columns = ["query_id", "path", "nodes", "cost", "arrival", "pieces"]
    done = start.join(queries.where("src = dst").select("query_id"), "query_id", "left_semi").select(*columns)
    front = checkpoint(start.join(q.select("query_id"), "query_id", "left_semi"))
    reach = bounds.select("query_id", F.col("node").alias("v"), "to_dst")
    arcs = edges.select(F.col("u").alias("node"), "v", "arc_id", "lb", F.col("knots").alias("_k"), F.col("pieces").alias("_p"))
    rounds = 0
    while front.limit(1).count() and (max_arcs is None or rounds < max_arcs):
        step = front.join(arcs, "node").where("not array_contains(nodes, v)").join(reach, ["query_id", "v"]).where("cost + lb + to_dst <= b")
        grown = step.select("query_id", F.col("v").alias("node"), "dst", "b", F.concat("path", F.array("arc_id")).alias("path"), F.concat("nodes", F.array("v")).alias("nodes"), (F.col("cost") + F.col("lb")).alias("cost"), "arrival", "pieces", "_k", "_p")
        grown = grown.mapInArrow(grow, f"query_id int, node int, dst int, b int, path array<int>, nodes array<int>, cost double, arrival {ARRIVAL}, pieces {PIECES}")
        grown = checkpoint(grown)
        done = done.unionByName(grown.where("node = dst").select(*columns))
        front = grown.where("node <> dst")
        rounds += 1
    return done


def point_labels(edges: DataFrame, queries: DataFrame, departures: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Earliest arrivals ``(query_id, t, node, arrival)`` from each query's source for departures ``(query_id, t)``.

    Arrivals beyond t + b are dropped. FIFO arcs make an earlier label never worse.
    """
    first = departures.join(queries.select("query_id", F.col("src").alias("node"), "b"), "query_id").select("query_id", "t", "node", F.col("t").cast("double").alias("cost"), (F.col("t") + F.col("b")).alias("limit"))
    found = C.spread(edges, first, ["query_id", "t"], "arrival", True, cells)
    return found.select("query_id", "t", F.col("node").cast(dict(edges.dtypes)["u"]).alias("node"), F.col("cost").alias("arrival"))


def latest_labels(edges: DataFrame, queries: DataFrame, deadlines: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Latest departures ``(query_id, deadline, node, departure)`` that still reach each query's destination in time."""
    first = deadlines.join(queries.select("query_id", F.col("dst").alias("node"), "b"), "query_id").select("query_id", "deadline", "node", (-F.col("deadline").cast("double")).alias("cost"), (F.col("b") - F.col("deadline")).alias("limit"))
    found = C.spread(edges, first, ["query_id", "deadline"], "departure", False, cells)
    return found.select("query_id", "deadline", F.col("node").cast(dict(edges.dtypes)["u"]).alias("node"), (-F.col("cost")).alias("departure"))


def replay_at(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Walk ``paths(id…, path, t)`` at fixed departures: adds ``arrival`` and ``score``, null where a travel time is undefined.

    One round an arc position, joined on the arc.
    """
    longest = paths.agg(F.max(F.size("path"))).first()[0] or 0
    arcs = edges.select(F.col("arc_id").alias("_arc"), F.col("knots").alias("_k"), F.col("pieces").alias("_p"))
    cur = paths.withColumn("arrival", F.col("t").cast("double")).withColumn("score", F.lit(0).cast("long"))
    for i in range(longest):
        more = F.size("path") > i
        cur = cur.withColumn("_at", F.get("path", F.lit(i))).join(arcs, F.col("_at") == F.col("_arc"), "left")
        cur = cur.withColumn("score", F.when(more, F.col("score") + T.score_at(F.col("_p"), F.col("arrival"))).otherwise(F.col("score"))).withColumn("arrival", F.when(more, T.arrival_at(F.col("_k"), F.col("arrival"))).otherwise(F.col("arrival"))).drop("_at", "_arc", "_k", "_p")
    return cur
