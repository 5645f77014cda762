"""Bounded search: partial paths as a relation that advances a layer at a time and is thinned inside every layer.

A path is cut at its *pivots*, the query's arcs of highest score. ``connectors`` are loopless ways between pivots, found
best first with a cap in every round; ``layered`` joins partial paths with connectors and the next pivot, prunes them by
dominance, by retention in each temporal cell and by an optimistic score, and closes them at the destination. Where no
cap binds the envelope is that of all loopless paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronopath.functions import temporal as T
from chronopath.functions.profiles import ARRIVAL, PIECES, grow, walk
from chronopath.operators import envelopes as E
from chronopath.operators import paths as P
from chronopath.plans.materialize import checkpoint

NO_CAP = 1 << 30


@dataclass(frozen=True)
class Bounded:
    """theta: pivots on a path; pivots: arcs that may be one; connectors: kept of a pair of places; width: partial
    connectors of a pair that stay open after a round; kept: partial paths in a temporal cell; bound: prune by score."""

    theta: int = 2
    pivots: int = 4
    connectors: int = 4
    width: int = 64
    kept: int = 4
    bound: bool = True

    def __post_init__(self):
        if self.theta < 0 or min(self.pivots, self.connectors, self.width, self.kept) < 1:
            raise ValueError("caps must be positive")


@dataclass(frozen=True)
class Found:
    """``candidates`` as of ``paths.profiles``, and ``caps(query_id, connectors, labels, ended)``: how many connectors,
    partial or whole, and partial paths each query's caps have dropped, and how many partial paths theta has ended that
    had pivots left. Zeros mean that the envelope is exact."""

    candidates: DataFrame
    caps: DataFrame


def _start(queries: DataFrame) -> DataFrame:
    knot = lambda c: F.struct(F.col(c).cast("double").alias("t"), F.col(c).cast("double").alias("v"))
    return queries.select(
        "query_id", F.col("src").alias("node"), F.array().cast("array<int>").alias("path"), F.array("src").alias("nodes"), F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("used"),
        F.when(F.col("ts") < F.col("te"), F.array(knot("ts"), knot("te"))).otherwise(F.array(knot("ts"))).alias("arrival"),
        F.array(F.struct(F.col("ts").cast("double").alias("t0"), F.col("te").cast("double").alias("t1"), F.lit(0).cast("long").alias("score"))).alias("pieces"),
    )


def score_rate(edges: DataFrame, corridor: DataFrame) -> DataFrame:
    """``(query_id, rate)``: the most score that a minute can bring on any arc of the query's corridor."""
    per = edges.select("arc_id", (T.score_max(F.col("pieces")) / F.col("lb")).alias("rate"))
    return corridor.join(per, "arc_id").groupBy("query_id").agg(F.max("rate").alias("rate"))


def can_improve(labels: DataFrame, won: DataFrame, queries: DataFrame, rates: DataFrame) -> DataFrame:
    """``labels`` whose score so far plus what the rest of their budget could bring reaches the winner's somewhere.

    ``won`` are winners of all cells of each query (path null: none yet, which anything improves).
    """
    key = ["query_id", "path"]
    parts = E.pieces(labels.select("query_id", "path", "arrival", "pieces"), queries)
    x = parts.join(rates, "query_id").join(queries.select("query_id", "b"), "query_id").join(won.select("query_id", "lo", "hi", F.col("path").alias("w_path"), F.col("score").alias("w_score")), "query_id")
    x = x.where((F.col("s") <= F.col("hi")) & (F.col("lo") <= F.col("e")))
    at = lambda t: F.when(F.col("s") == F.col("e"), F.col("a0")).otherwise(F.col("a0") + F.try_divide((F.col("a1") - F.col("a0")) * (t - F.col("s")), F.col("e") - F.col("s")))
    best = lambda t: F.col("score") + F.greatest(F.col("b") - (at(t) - t), F.lit(0.0)) * F.col("rate")
    hope = F.col("w_path").isNull() | (F.greatest(best(F.greatest("s", "lo")), best(F.least("e", "hi"))) >= F.col("w_score") - 1e-9)
    return labels.join(x.where(hope).select(*key).distinct(), key, "left_semi")


def connectors(edges: DataFrame, arcs: DataFrame, pairs: DataFrame, k: int, width: int) -> tuple[DataFrame, DataFrame]:
    """At most k loopless connectors of each pair ``(query_id, a, z, b)``, by way of the query's ``arcs(query_id, arc_id)``.

    Rows ``(query_id, a, z, slot, path, nodes, cost)``, and how many connectors the caps dropped, by query. Every round extends all open ones by an arc whose least time, with that of the way left, stays within b; the
    ``width`` ones of least completion stay open. Chosen are in turn the fastest, the best scored, the one that shares
    least with the fastest, and the fastest again; a pair of equal places has the empty connector alone.
    """
    goals = pairs.groupBy("query_id", "z").agg(F.max("b").alias("b"))
    goal = F.shiftleft(F.col("query_id").cast("long"), 32) + F.col("z")
    home = P.lower_bounds(edges, goals.select(goal.alias("query_id"), F.col("z").alias("node"), "b"), forward=False).select(F.col("query_id").alias("_goal"), F.col("node").alias("v"), F.col("cost").alias("home"))
    per = edges.select("arc_id", F.col("u").alias("node"), "v", "lb", (F.col("lb") / (1 + T.score_max(F.col("pieces")))).alias("dull"))
    steps = arcs.join(per, "arc_id")
    columns = ["query_id", "a", "z", "path", "nodes", "cost", "dull"]
    start = pairs.select("query_id", "a", "z", "b", F.col("a").alias("node"), F.array().cast("array<int>").alias("path"), F.array("a").alias("nodes"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("dull"))
    done = start.where("a = z").select(*columns)
    front, dropped = start.where("a <> z"), None
    while True:
        step = front.join(steps.withColumnRenamed("dull", "_d"), ["query_id", "node"]).where("not array_contains(nodes, v)").withColumn("_goal", goal).join(home, ["_goal", "v"]).where("cost + lb + home <= b + 1e-9")
        grown = step.select("query_id", "a", "z", "b", F.col("v").alias("node"), F.concat("path", F.array("arc_id")).alias("path"), F.concat("nodes", F.array("v")).alias("nodes"), (F.col("cost") + F.col("lb")).alias("cost"), (F.col("dull") + F.col("_d")).alias("dull"), (F.col("cost") + F.col("lb") + F.col("home")).alias("whole"))
        w = Window.partitionBy("query_id", "a", "z", F.col("node") == F.col("z")).orderBy("whole", "path")
        grown = checkpoint(grown.withColumn("_r", F.row_number().over(w)))
        ended = F.col("node") == F.col("z")
        done = done.unionByName(grown.where(ended).select(*columns))
        front = grown.where(~ended & (F.col("_r") <= width)).drop("_r", "whole")
        lost = grown.where(~ended & (F.col("_r") > width)).groupBy("query_id").agg(F.count("*").alias("n"))
        dropped = lost if dropped is None else dropped.union(lost)
        if not front.limit(1).count():
            break
    pair = ["query_id", "a", "z"]
    rank = lambda *o: F.row_number().over(Window.partitionBy(*pair).orderBy(*o, F.size("path"), "path")) - 1
    ranked = done.withColumn("_f", rank("cost"))
    first = ranked.where("_f = 0").select(*pair, F.col("path").alias("_first"))
    shared = ranked.select(*pair, "path", F.explode("path").alias("arc_id")).join(first, pair).where(F.array_contains("_first", F.col("arc_id"))).join(edges.select("arc_id", "lb"), "arc_id").groupBy(*pair, "path").agg(F.sum("lb").alias("_shared"))
    ranked = ranked.join(shared, [*pair, "path"], "left").na.fill(0.0, ["_shared"]).withColumn("_s", rank(F.round("dull", 9), "cost")).withColumn("_d", rank(F.col("cost") + F.col("_shared"), "cost"))
    more = ranked.groupBy("query_id", "a", "z").count().where(F.col("count") > k).groupBy("query_id").agg(F.sum(F.col("count") - k).alias("n"))
    dropped = checkpoint(dropped.union(more))
    turn = F.least(4 * F.floor(F.col("_f") / 2) + F.when(F.col("_f") % 2 == 0, 0).otherwise(3), 4 * F.col("_s") + 1, 4 * F.col("_d") + 2)
    chosen = ranked.withColumn("slot", F.row_number().over(Window.partitionBy(*pair).orderBy(turn, "_f")))
    return checkpoint(chosen.where(F.col("slot") <= k).select(*pair, "slot", "path", "nodes", "cost")), dropped


def _with_arcs(ways: DataFrame, edges: DataFrame) -> DataFrame:
    """``ways`` with the functions of their arcs in order, as ``_ks`` and ``_ps``."""
    key = ["query_id", "a", "z", "path"]
    parts = ways.select(*key, F.posexplode("path").alias("i", "arc_id")).join(edges.select("arc_id", "knots", "pieces"), "arc_id")
    lists = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "knots", "pieces"))).alias("_l"))
    return ways.join(lists, key, "left").withColumn("_ks", F.coalesce(F.transform("_l", lambda x: x["knots"]), F.array().cast(f"array<{ARRIVAL}>"))).withColumn("_ps", F.coalesce(F.transform("_l", lambda x: x["pieces"]), F.array().cast(f"array<{PIECES}>"))).drop("_l")


def _walked(rows: DataFrame) -> DataFrame:
    return rows.mapInArrow(walk, f"query_id int, node int, path array<int>, nodes array<int>, cost double, used array<int>, arrival {ARRIVAL}, pieces {PIECES}")


def _least_travel(arrival: Column) -> Column:
    return T.min_value(T.to_travel(arrival))


def thinned(labels: DataFrame, room: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Partial paths that stay open: in each state (query, node, pivots used) and each temporal cell those that no other
    beats, and of these at most k. ``room(query_id, node, ts, te, b)`` is what the budget leaves to get to the node.

    Also how many labels the cap k dropped, by query.
    """
    state = F.xxhash64("query_id", "node", "used")
    keyed = labels.withColumn("state", state)
    inside = keyed.select("state", "query_id", "node").distinct().join(room, ["query_id", "node"]).select(F.col("state").alias("query_id"), "ts", "te", "b")
    parts = E.pieces(keyed.select(F.col("state").alias("query_id"), "path", "arrival", "pieces"), inside)
    parts = checkpoint(parts)
    covered = E.in_cells(parts, E.cells(parts, inside))
    open_ones = checkpoint(E.open_undominated(covered, keyed.select(F.col("state").alias("query_id"), "path", "nodes")))
    kept = E.retain(E.cell_integrals(open_ones, inside), k)
    pick = lambda x: x.select(F.col("query_id").alias("state"), "path").distinct()
    stay = checkpoint(keyed.join(pick(kept), ["state", "path"], "left_semi").drop("state"))
    lost = keyed.join(pick(open_ones), ["state", "path"], "left_semi").join(pick(kept), ["state", "path"], "left_anti").groupBy("query_id").agg(F.count("*").alias("n"))
    return stay, lost


def layered(edges: DataFrame, queries: DataFrame, pivots: DataFrame, bounds: DataFrame, o: Bounded) -> Found:
    """Candidate paths of each query by layers of pivots ``(query_id, arc_id, rank)``; see the module.

    Layer n holds partial paths that end with their n-th pivot. Connectors keep off the query's pivots, so that each
    path comes once, by the pivots that it has.
    """
    q = queries.select("query_id", "src", "dst", "ts", "te", "b")
    corridor = P.corridor(edges, queries, bounds)
    piv = checkpoint(pivots.where(F.col("rank") <= o.pivots).join(edges.select("arc_id", "u", "v", "lb", "knots", "pieces"), "arc_id").where("u <> v").select("query_id", F.col("arc_id").alias("pivot"), "u", "v", F.col("lb").alias("p_lb"), F.col("knots").alias("p_k"), F.col("pieces").alias("p_p")))
    arcs = checkpoint(corridor.select("query_id", "arc_id").join(piv.select("query_id", F.col("pivot").alias("arc_id")), ["query_id", "arc_id"], "left_anti"))
    reach = bounds.select("query_id", "node", "from_src", "to_dst")
    froms = q.select("query_id", F.col("src").alias("a")).union(piv.select("query_id", "v")).distinct()
    ends = q.select("query_id", F.col("dst").alias("z")).union(piv.select("query_id", "u")).distinct()
    pairs = froms.join(ends, "query_id").join(reach.select("query_id", F.col("node").alias("a"), "from_src"), ["query_id", "a"]).join(reach.select("query_id", F.col("node").alias("z"), "to_dst"), ["query_id", "z"]).join(q.select("query_id", "b"), "query_id")
    pairs = pairs.select("query_id", "a", "z", (F.col("b") - F.col("from_src") - F.col("to_dst")).alias("b")).where("b >= 0")
    ways, lost = connectors(edges, arcs, pairs, o.connectors, o.width)
    ways = checkpoint(_with_arcs(ways, edges)).select("query_id", F.col("a").alias("node"), "z", F.col("path").alias("w_path"), F.slice("nodes", 2, 1 << 20).alias("w_nodes"), F.col("cost").alias("w_cost"), "_ks", "_ps")
    rates = score_rate(edges, corridor) if o.bound else None
    room = q.join(reach, "query_id").select("query_id", "node", "ts", "te", (F.col("b") - F.col("to_dst")).alias("b"))
    columns = ["query_id", "path", "nodes", "cost", "arrival", "pieces"]
    front, done, labels_lost = checkpoint(_start(q)), None, None
    for depth in range(o.theta + 1):
        open_ways = front.join(ways, ["query_id", "node"]).where(~F.arrays_overlap("nodes", "w_nodes"))
        final = open_ways.join(q.select("query_id", F.col("dst").alias("z"), "b"), ["query_id", "z"]).where("cost + w_cost <= b + 1e-9")
        final = final.select("query_id", F.col("z").alias("node"), F.concat("path", "w_path").alias("path"), F.concat("nodes", "w_nodes").alias("nodes"), (F.col("cost") + F.col("w_cost")).alias("cost"), "used", "arrival", "pieces", "_ks", "_ps")
        ended = checkpoint(_walked(final)).select(*columns)
        done = ended if done is None else checkpoint(done.unionByName(ended))
        if depth == o.theta:
            break
        if o.bound:
            parts = E.pieces(done, q)
            grid = E.cells(parts, q)
            hopeful = can_improve(front, E.winners(E.in_cells(parts, grid), grid), q, rates)
            open_ways = open_ways.join(hopeful.select("query_id", "path"), ["query_id", "path"], "left_semi")
        more = open_ways.join(piv.withColumnRenamed("u", "z"), ["query_id", "z"]).where("not array_contains(used, pivot) and not array_contains(nodes, v) and not array_contains(w_nodes, v)")
        more = more.join(reach.select("query_id", F.col("node").alias("v"), "to_dst"), ["query_id", "v"]).join(q.select("query_id", "b"), "query_id").where("cost + w_cost + p_lb + to_dst <= b + 1e-9")
        more = more.select(
            "query_id", F.col("v").alias("node"), F.concat("path", "w_path", F.array("pivot")).alias("path"), F.concat("nodes", "w_nodes", F.array("v")).alias("nodes"), (F.col("cost") + F.col("w_cost") + F.col("p_lb")).alias("cost"),
            F.array_sort(F.concat("used", F.array("pivot"))).alias("used"), "arrival", "pieces", F.concat("_ks", F.array("p_k")).alias("_ks"), F.concat("_ps", F.array("p_p")).alias("_ps"),
        )
        grown = checkpoint(_walked(more)).join(reach.select("query_id", "node", "to_dst"), ["query_id", "node"]).join(q.select("query_id", "b"), "query_id")
        grown = grown.where(_least_travel(F.col("arrival")) + F.col("to_dst") <= F.col("b") + 1e-9).drop("to_dst", "b")
        if not grown.limit(1).count():
            break
        front, dropped = thinned(grown, room, o.kept)
        labels_lost = dropped if labels_lost is None else labels_lost.union(dropped)
    ended = None
    if depth == o.theta and o.theta < o.pivots:
        ended = front.join(piv, "query_id").where("not array_contains(used, pivot)").groupBy("query_id").agg(F.count_distinct("path").alias("n"))
    none = queries.select("query_id", F.lit(0).cast("long").alias("n"))
    total = lambda x, name: (none if x is None else none.union(x)).groupBy("query_id").agg(F.sum("n").alias(name))
    return Found(done, total(lost, "connectors").join(total(labels_lost, "labels"), "query_id").join(total(ended, "ended"), "query_id"))


def labels_exact(edges: DataFrame, queries: DataFrame, bounds: DataFrame) -> DataFrame:
    """Candidates of the exact envelope by extending labels an arc at a time and dropping those that another label at
    their node beats for good: equal arrivals throughout, nowhere a smaller score (nor, where it is the same, more edges
    or a larger path), and only nodes that the beaten one has visited too.

    Labels meet by (query, node, arrival function), never all of a node.
    """
    q = queries.select("query_id", "src", "dst", "ts", "te", "b")
    reach = bounds.select("query_id", F.col("node").alias("v"), "to_dst")
    arcs = edges.select(F.col("u").alias("node"), "v", "arc_id", "lb", F.col("knots").alias("_k"), F.col("pieces").alias("_p"))
    columns = ["query_id", "path", "nodes", "cost", "arrival", "pieces"]
    start = _start(q).drop("used").join(q.select("query_id", "dst", "b"), "query_id")
    done = start.where("node = dst").select(*columns)
    front = checkpoint(start.where("node <> dst"))
    seen = front.withColumn("_key", _function_key(F.col("arrival")))
    while front.limit(1).count():
        step = front.join(arcs, "node").where("not array_contains(nodes, v)").join(reach, ["query_id", "v"]).where("cost + lb + to_dst <= b")
        grown = step.select("query_id", F.col("v").alias("node"), "dst", "b", "to_dst", F.concat("path", F.array("arc_id")).alias("path"), F.concat("nodes", F.array("v")).alias("nodes"), (F.col("cost") + F.col("lb")).alias("cost"), "arrival", "pieces", "_k", "_p")
        grown = grown.mapInArrow(grow, f"query_id int, node int, dst int, b int, to_dst double, path array<int>, nodes array<int>, cost double, arrival {ARRIVAL}, pieces {PIECES}")
        grown = checkpoint(grown.where(_least_travel(F.col("arrival")) + F.col("to_dst") <= F.col("b") + 1e-9).drop("to_dst").withColumn("_key", _function_key(F.col("arrival"))))
        pool = seen.select(*grown.columns).unionByName(grown)
        o = pool.select("query_id", "node", "_key", F.col("path").alias("o_path"), F.col("nodes").alias("o_nodes"), F.col("pieces").alias("o_pieces"))
        same = grown.join(o, ["query_id", "node", "_key"]).where((F.col("path") != F.col("o_path")) & (F.size(F.array_except("o_nodes", "nodes")) == 0))
        first = F.struct(F.size("o_path"), "o_path") < F.struct(F.size("path"), "path")
        mids = T.score_on(F.concat(F.transform("pieces", lambda p: p["t0"]), F.transform("pieces", lambda p: p["t1"]), F.transform("o_pieces", lambda p: p["t0"]), F.transform("o_pieces", lambda p: p["t1"])), lambda t: T.score_at(F.col("o_pieces"), t) - T.score_at(F.col("pieces"), t))
        ends = lambda t: T.score_at(F.col("o_pieces"), t) - T.score_at(F.col("pieces"), t)
        wins = lambda d: (d > 0) | ((d == 0) & first)
        last = F.element_at("pieces", -1)["t1"]
        beaten = same.where(F.forall(mids, lambda m: wins(m["score"])) & wins(ends(last))).select("query_id", "path").distinct()
        left = checkpoint(grown.join(beaten, ["query_id", "path"], "left_anti"))
        done = done.unionByName(left.where("node = dst").select(*columns))
        front = left.where("node <> dst").drop("_key")
        seen = seen.select(*left.columns).unionByName(left.where("node <> dst"))
    return done


def _function_key(arrival: Column) -> Column:
    """Equal for equal functions: knots to nine decimals."""
    return F.array_join(F.transform(arrival, lambda k: F.concat_ws(":", F.round(k["t"], 9).cast("string"), F.round(k["v"], 9).cast("string"))), ",")


def anytime(edges: DataFrame, queries: DataFrame, bounds: DataFrame, width: int, rounds: int):
    """Best-first search that can be stopped: after each round, the candidates committed so far; their envelope never
    gets worse. A round extends the ``width`` open paths of each query with the least completion by lower bounds; the
    others stay open. Ends when nothing is open, or after ``rounds``."""
    q = queries.select("query_id", "src", "dst", "ts", "te", "b")
    reach = bounds.select("query_id", F.col("node").alias("v"), "to_dst")
    arcs = edges.select(F.col("u").alias("node"), "v", "arc_id", "lb", F.col("knots").alias("_k"), F.col("pieces").alias("_p"))
    columns = ["query_id", "path", "nodes", "cost", "arrival", "pieces"]
    start = _start(q).drop("used").join(q.select("query_id", "dst", "b"), "query_id")
    committed = start.where("node = dst").select(*columns)
    waiting = checkpoint(start.where("node <> dst").withColumn("whole", F.lit(0.0)))
    for _ in range(rounds):
        ranked = waiting.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("whole", F.size("path").desc(), "path")))
        step = ranked.where(F.col("_r") <= width).drop("whole", "_r").join(arcs, "node").where("not array_contains(nodes, v)").join(reach, ["query_id", "v"]).where("cost + lb + to_dst <= b")
        grown = step.select("query_id", F.col("v").alias("node"), "dst", "b", (F.col("cost") + F.col("lb") + F.col("to_dst")).alias("whole"), F.concat("path", F.array("arc_id")).alias("path"), F.concat("nodes", F.array("v")).alias("nodes"), (F.col("cost") + F.col("lb")).alias("cost"), "arrival", "pieces", "_k", "_p")
        grown = checkpoint(grown.mapInArrow(grow, f"query_id int, node int, dst int, b int, whole double, path array<int>, nodes array<int>, cost double, arrival {ARRIVAL}, pieces {PIECES}"))
        committed = committed.unionByName(grown.where("node = dst").select(*columns))
        waiting = checkpoint(ranked.where(F.col("_r") > width).drop("_r").unionByName(grown.where("node <> dst")))
        yield committed
        if not waiting.limit(1).count():
            return
