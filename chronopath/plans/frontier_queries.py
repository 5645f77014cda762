"""Queries of the bounded search, interval labels and growing frontiers, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopath.functions import temporal as T
from chronopath.operators import algorithms as A
from chronopath.operators import budgets as B
from chronopath.operators import envelopes as E
from chronopath.operators import frontier as FR
from chronopath.operators import incremental as I
from chronopath.operators import interval_labels as L
from chronopath.operators import paths as P
from chronopath.operators import validate as V
from chronopath.plans import profile_queries as PQ
from chronopath.plans.graph_queries import _AT, _ENUM, _WALKS, _bounds, _grid, _held, _text
from chronopath.plans.graph_queries import SQL as GRAPH_SQL
from chronopath.plans.temporal_graph import graph, sql


def _best_at_grid(spark, sf, candidates, fastest=False):
    """Best path at grid departures, read from the exact envelope of the candidates."""
    g = graph(spark, sf)
    return E.at_points(E.envelope(candidates, g.queries, fastest), _grid(g.queries)).where("path is not null and size(path) > 0").select("query_id", "t", _text())


def _corridor(spark, sf):
    g = graph(spark, sf)
    return P.corridor(g.edges, g.queries, _bounds(spark, sf))


def i17_layered(spark, sf):
    """Layers over two pivots without caps: the exact envelope."""
    g = graph(spark, sf)
    o = FR.Bounded(theta=2, pivots=2, connectors=FR.NO_CAP, width=FR.NO_CAP, kept=FR.NO_CAP)
    return _best_at_grid(spark, sf, FR.layered(g.edges, g.queries, A.pivots(g, g.queries, _corridor(spark, sf), 2), _bounds(spark, sf), o).candidates)


def i25_labels_exact(spark, sf):
    g = graph(spark, sf)
    return _best_at_grid(spark, sf, FR.labels_exact(g.edges, g.queries, _bounds(spark, sf)))


def i29_anytime(spark, sf):
    """Committed paths when nothing is left open."""
    g = graph(spark, sf)
    *_, last = FR.anytime(g.edges, g.queries, _bounds(spark, sf), 40, 1000)
    return _best_at_grid(spark, sf, last)


def _connectors(spark, sf, k):
    g = graph(spark, sf)
    pairs = g.queries.where("src <> dst").select("query_id", F.col("src").alias("a"), F.col("dst").alias("z"), F.col("b").cast("double").alias("b"))
    return FR.connectors(g.edges, _corridor(spark, sf).select("query_id", "arc_id"), pairs, k, FR.NO_CAP)[0]


def i8_connectors(spark, sf):
    """The first eight of each query's connectors, taken in turn from three orders."""
    return _connectors(spark, sf, 8).select("query_id", "slot", _text())


def i9_fastest_witness(spark, sf):
    return _connectors(spark, sf, 1).select("query_id", "cost", _text())


def i21_score_rate(spark, sf):
    return FR.score_rate(graph(spark, sf).edges, _corridor(spark, sf)).select("query_id", F.round("rate", 6).alias("rate"))


def _labels(spark, sf):
    g = graph(spark, sf)
    return _held(spark, sf, "interval labels", lambda: L.labels(g.edges, g.queries))


def i15_fastest_profile(spark, sf):
    """Each node's earliest arrival at grid departures, read from its profile."""
    g = graph(spark, sf)
    return L.arrivals_at(_labels(spark, sf), A.grid(g.queries, 10)).select("query_id", "t", "node", F.round("arrival", 6).alias("arrival"))


def i16_fastest_witness_paths(spark, sf):
    """The path that the destination's profile follows at grid departures."""
    g = graph(spark, sf)
    at = L.arrivals_at(_labels(spark, sf), _grid(g.queries)).join(g.queries.select("query_id", F.col("dst").alias("node")), ["query_id", "node"], "left_semi")
    return at.where("size(path) > 0").select("query_id", "t", _text())


def i30_all_fastest(spark, sf):
    """Fastest paths found without a budget, at the grid departures whose budget they keep."""
    g = graph(spark, sf)
    segments, profiles = L.all_fastest(g.edges, g.queries)
    at = E.at_points(segments, _grid(g.queries)).where("path is not null and size(path) > 0").join(profiles.select("query_id", "path", "arrival"), ["query_id", "path"]).join(g.queries.select("query_id", "b"), "query_id")
    t = F.col("t").cast("double")
    return at.where(F.round(T.value_at(F.col("arrival"), t) - t, 6) <= F.col("b")).select("query_id", "t", _text())


def _pieces(cells):
    return cells.select("query_id", "path", "n_edges", F.col("lo").alias("s"), F.col("hi").alias("e"), (F.col("lo") + F.col("travel_lo")).alias("a0"), (F.col("hi") + F.col("travel_hi")).alias("a1"), "score")


def c13_growing_frontier(spark, sf):
    """Lines with odd numbers come first, the others are added: what dominance leaves, as longest stretches."""
    parts, budgets = _pieces(PQ._candidates(spark, sf)), PQ._budgets(spark, sf)
    odd = F.get("path", F.lit(0)) % 2 == 1
    first = I.insert(parts.limit(0), parts.where(odd), budgets, FR.NO_CAP)
    kept = I.insert(P.checkpoint(first), parts.where(~odd), budgets, FR.NO_CAP).where("s < e")
    # One row for each ten minutes, so that stretches cut in other places compare.
    cells = kept.select("query_id", F.get("path", F.lit(0)).alias("path"), "score", F.explode(F.sequence(F.floor(F.col("s") / 10).cast("int"), (F.ceil(F.col("e") / 10) - 1).cast("int"))).alias("cell"))
    return cells.distinct()


def c7_open_dominance(spark, sf):
    """Dominance among paths that can still be extended: line p has visited the nodes 1 to p % 3 + 1."""
    c = PQ._candidates(spark, sf)
    nodes = c.select("query_id", "path", F.sequence(F.lit(1), (F.get("path", F.lit(0)) % 3 + 1).cast("int")).alias("nodes")).distinct()
    return PQ._kept(E.open_undominated(c, nodes), "score")


def j3_corridor_anchors(spark, sf):
    """Arcs with a score that each query's budget, and half of it, leave on the way."""
    g = graph(spark, sf)
    w = g.queries.select("query_id", "ts", "te", F.explode(F.array(F.struct(F.lit("WHOLE").alias("variant"), F.col("b").cast("double").alias("budget")), F.struct(F.lit("HALF").alias("variant"), (F.col("b") / 2).alias("budget")))).alias("x")).select("query_id", "ts", "te", "x.*")
    return B.anchor_counts(g.edges, g.scores, _bounds(spark, sf), w)


def j2_budget_variants(spark, sf):
    """Main and tight budgets of customers whose fastest times are their orders' least and largest prices."""
    x = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").alias("query_id")).agg((F.min("o_totalprice") / 1000).cast("decimal(20,6)").cast("double").alias("least"), (F.max("o_totalprice") / 1000).cast("decimal(20,6)").cast("double").alias("most"))
    return B.variants(x, 0.25, 0.1).withColumn("budget", F.round("budget", 6))


def j9_payload_gates(spark, sf):
    """Suppliers as arcs: prices and quantities of their lines are functions and scores that break some of the rules."""
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    arc = (F.col("l_suppkey") - 1).cast("int").alias("arc_id")
    at = (F.col("l_orderkey") % 24 * 10).cast("double")
    knots = line.groupBy(arc, at.alias("t")).agg((F.max("l_quantity") - 1).cast("double").alias("v")).groupBy("arc_id").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("knots"))  # at most 24 each
    pieces = line.groupBy(arc, at.alias("t0")).agg((F.count("*") % 20).alias("score")).groupBy("arc_id").agg(F.sort_array(F.collect_list(F.struct("t0", (F.col("t0") + 10).alias("t1"), "score"))).alias("pieces"))
    s = spark.read.parquet(f"{sf}/supplier.parquet").select((F.col("s_suppkey") - 1).cast("int").alias("arc_id"), F.col("s_nationkey").alias("u"), (F.col("s_suppkey") % 25).cast("int").alias("v"), F.col("s_acctbal").alias("base"))
    functions = s.join(knots, "arc_id").withColumn("u", F.when(F.col("arc_id") % 11 == 0, 99).otherwise(F.col("u"))).withColumn("base", F.when(F.col("arc_id") % 13 == 0, F.col("base") + 1).otherwise(F.col("base")))
    return V.payload(s, functions, pieces, 230.0, 18).na.fill(-9, ["first_bad"])


_FIRST = " SELECT query_id, t, path FROM (SELECT *, row_number() OVER (PARTITION BY query_id, t ORDER BY {order}) AS k FROM got) WHERE k = 1"
_BEST, _FASTEST = sql(_AT + _FIRST.format(order="score DESC, arrival, n, p"), True), sql(_AT + _FIRST.format(order="arrival, n, p"), True)
_RANKED = _ENUM + """, arc AS (SELECT f.query_id, f.path, u.i, l.lb, l.lb / (1 + s.top) AS dull, e.arc_id FROM full_p f, unnest(range(1, len(f.path) + 1)) AS u(i) JOIN edges e ON e.arc_id = f.path[u.i] JOIN lows l ON l.arc_id = e.arc_id JOIN (SELECT arc_id, max(score) AS top FROM scores GROUP BY 1) s ON s.arc_id = e.arc_id),
fst AS (SELECT query_id, path AS first FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cost, len(path), path) AS r FROM full_p) WHERE r = 1),
sums AS (SELECT a.query_id, a.path, sum(a.lb) AS cost, sum(a.dull) AS dull, sum(CASE WHEN list_contains(f.first, a.arc_id) THEN 2 * a.lb ELSE a.lb END) AS apart FROM arc a JOIN fst f USING (query_id) GROUP BY 1, 2),
rk AS (SELECT query_id, path, cost, row_number() OVER (PARTITION BY query_id ORDER BY cost, len(path), path) - 1 AS f, row_number() OVER (PARTITION BY query_id ORDER BY round(dull, 9), cost, len(path), path) - 1 AS s, row_number() OVER (PARTITION BY query_id ORDER BY apart, cost, len(path), path) - 1 AS d FROM sums),
tn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY least(4 * (f // 2) + CASE WHEN f % 2 = 0 THEN 0 ELSE 3 END, 4 * s + 1, 4 * d + 2), f) AS slot FROM rk)"""
SQL = {
    "i17_layered": _BEST,
    "i25_labels_exact": _BEST,
    "i29_anytime": _BEST,
    "i8_connectors": sql(_RANKED + " SELECT query_id, slot, array_to_string(path, '-') AS path FROM tn WHERE slot <= 8", True),
    "i9_fastest_witness": sql(_RANKED + " SELECT query_id, cost, array_to_string(path, '-') AS path FROM tn WHERE f = 0", True),
    "i21_score_rate": sql(_WALKS + ", cor AS (SELECT q.query_id, e.arc_id, l.lb, q.b - a.from_src - l.lb - z.to_dst AS slack FROM qs q JOIN bnd a ON a.query_id = q.query_id JOIN edges e ON e.u = a.node JOIN lows l ON l.arc_id = e.arc_id JOIN bnd z ON z.query_id = q.query_id AND z.node = e.v WHERE e.u <> e.v) SELECT query_id, round(max(s.score / lb), 6) AS rate FROM cor JOIN scores s USING (arc_id) WHERE slack >= 0 GROUP BY 1", True),
    "j3_corridor_anchors": sql(_WALKS + """, w AS (SELECT query_id, ts, te, 'WHOLE' AS variant, CAST(b AS double) AS budget FROM qs UNION ALL SELECT query_id, ts, te, 'HALF', b / 2.0 FROM qs),
h AS (SELECT w.query_id, w.variant, count(*) AS n FROM w JOIN bnd a ON a.query_id = w.query_id JOIN edges e ON e.u = a.node JOIN lows l ON l.arc_id = e.arc_id JOIN bnd z ON z.query_id = w.query_id AND z.node = e.v WHERE a.from_src + l.lb + z.to_dst <= w.budget AND EXISTS (SELECT 1 FROM scores s WHERE s.arc_id = e.arc_id AND s.score > 0 AND s.t0 <= w.te + w.budget AND s.t1 > w.ts) GROUP BY 1, 2)
SELECT w.query_id, w.variant, coalesce(h.n, 0) AS anchors FROM w LEFT JOIN h USING (query_id, variant)""", True),
    "j2_budget_variants": """WITH x AS (SELECT o_custkey AS query_id, CAST(min(o_totalprice) / 1000 AS decimal(20, 6)) AS lo, CAST(max(o_totalprice) / 1000 AS decimal(20, 6)) AS hi FROM orders GROUP BY 1), c AS (SELECT *, lo * 1.1 AS cand, lo + (hi - lo) * 0.25 AS q FROM x),
v AS (SELECT query_id, lo, hi, 'MAIN' AS variant, CAST(hi * 1.25 AS double) AS budget FROM c UNION ALL SELECT query_id, lo, hi, 'TIGHT', CAST(CASE WHEN lo < cand AND cand < hi THEN cand WHEN lo < hi THEN q ELSE cand END AS double) FROM c)
SELECT query_id, variant, round(budget, 6) AS budget, budget >= hi AS full, lo < hi AND lo <= budget AND budget < hi AS mixed FROM v""",
    "j9_payload_gates": """WITH s AS (SELECT s_suppkey - 1 AS a FROM supplier), k AS (SELECT l_suppkey - 1 AS a, l_orderkey % 24 * 10 AS t, max(l_quantity) - 1 AS v, count(*) % 20 AS score FROM lineitem GROUP BY 1, 2),
o AS (SELECT *, lag(t) OVER w AS pt, lag(t + v) OVER w AS pa FROM k WINDOW w AS (PARTITION BY a ORDER BY t)),
g AS (SELECT a, count(*) AS n, min(v) AS least, min(t) AS t0, max(t) AS t1, bool_and(pa IS NULL OR t + v >= pa) AS fifo, bool_and(pt IS NULL OR pt + 10 = t) AS whole, max(score) AS top FROM o GROUP BY a),
j AS (SELECT s.a, g.n, g.least, g.t0, g.t1, g.fifo, g.whole, g.top FROM s LEFT JOIN g USING (a)),
f AS (SELECT a, unnest([{'g': 'arc_ids', 'f': a < 0 OR a >= (SELECT count(*) FROM s)}, {'g': 'functions', 'f': n IS NULL}, {'g': 'endpoints', 'f': n IS NULL OR a % 11 = 0}, {'g': 'base_times', 'f': n IS NULL OR a % 13 = 0}, {'g': 'two_knots', 'f': n IS NULL OR n < 2}, {'g': 'minutes_rise', 'f': n IS NULL}, {'g': 'travel_positive', 'f': n IS NULL OR least <= 0}, {'g': 'fifo', 'f': n IS NULL OR NOT fifo}, {'g': 'support', 'f': n IS NULL OR t0 <> 0 OR t1 <> 230}, {'g': 'score_order', 'f': false}, {'g': 'score_contiguous', 'f': n IS NOT NULL AND NOT whole}, {'g': 'score_range', 'f': n IS NOT NULL AND top > 18}, {'g': 'score_support', 'f': n IS NOT NULL AND t1 + 10 > 230}]) AS x FROM j)
SELECT x.g AS gate, count(*) AS checked, CAST(sum(CASE WHEN x.f THEN 1 ELSE 0 END) AS bigint) AS failed, CAST(coalesce(min(CASE WHEN x.f THEN a END), -9) AS bigint) AS first_bad FROM f GROUP BY 1""",
    "i15_fastest_profile": GRAPH_SQL["i13_point_labels"],
    "i16_fastest_witness_paths": _FASTEST,
    "i30_all_fastest": _FASTEST,
    "c13_growing_frontier": f"WITH {PQ._CAND.format(src='c')}, {PQ._DOM} SELECT q AS query_id, p AS path, score, CAST(lo / 10 AS integer) AS cell FROM u",
    "c7_open_dominance": f"WITH {PQ._CAND.format(src='c')} SELECT q AS query_id, lo, hi, p AS path, score FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.q = c.q AND o.lo = c.lo AND o.v0 = c.v0 AND o.v1 = c.v1 AND o.p <> c.p AND o.p % 3 <= c.p % 3 AND (o.score > c.score OR (o.score = c.score AND (o.ne < c.ne OR (o.ne = c.ne AND o.p < c.p)))))",
}
QUERIES = {n: f for n, f in list(globals().items()) if n in SQL}
