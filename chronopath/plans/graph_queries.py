"""Queries over the derived temporal graph, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopath.functions import temporal as T
from chronopath.operators import algorithms as A
from chronopath.operators import cells as C
from chronopath.operators import envelopes as E
from chronopath.operators import paths as P
from chronopath.plans.temporal_graph import demo, graph, sql
from chronopath.plans.temporal_graph import release as release_graphs

_HELD: dict[tuple, DataFrame] = {}


def _held(spark, sf, name, make):
    """Search results that several queries of a session share; they are as small as the graph."""
    key = spark.sparkContext.applicationId, sf, name
    if key not in _HELD:
        _HELD[key] = make().persist()
    return _HELD[key]


def release(spark) -> None:
    """Let go of all that queries of this session share; the next one works it out anew."""
    for key in [k for k in _HELD if k[0] == spark.sparkContext.applicationId]:
        _HELD.pop(key).unpersist()
    release_graphs(spark)


def _bounds(spark, sf):
    g = graph(spark, sf)
    return _held(spark, sf, "bounds", lambda: P.both_bounds(g.edges, g.queries))


def _profiles(spark, sf):
    g = graph(spark, sf)
    return _held(spark, sf, "profiles", lambda: P.profiles(g.edges, g.queries, _bounds(spark, sf)))


def _pieces(spark, sf):
    return _held(spark, sf, "pieces", lambda: E.pieces(_profiles(spark, sf), graph(spark, sf).queries))


def _won(spark, sf, fastest=False):
    def make():
        parts = _pieces(spark, sf)
        grid = E.cells(parts, graph(spark, sf).queries, tied_only=not fastest)
        return E.winners(E.in_cells(parts, grid), grid, fastest)

    return _held(spark, sf, f"won{fastest}", make)


def _covered(spark, sf):
    def make():
        parts = _pieces(spark, sf)
        return E.in_cells(parts, E.cells(parts, graph(spark, sf).queries))

    return _held(spark, sf, "covered", make)


def _grid(queries, step=10):
    return queries.select("query_id", F.explode(F.sequence(F.col("ts").cast("long"), F.col("te").cast("long"), F.lit(step).cast("long"))).alias("t"))


def _text(c="path"):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "-").alias("path")


def flagship(spark, sf):
    """Best path segments of every query over its departures."""
    return E.merge_segments(_won(spark, sf)).select("query_id", "s", "e", "s_inc", "e_inc", _text())


def a14_graph_counts(spark, sf):
    g = graph(spark, sf)
    return g.edges.agg(F.count("*").alias("arcs"), F.count_distinct("u").alias("tails"), F.sum(T.score_max(F.col("pieces")).cast("long").cast("boolean").cast("long")).alias("scored"), F.sum((~T.is_fifo(F.col("knots"))).cast("long")).alias("not_fifo"))


def b_edge_functions(spark, sf):
    t = F.lit(487.5)
    k, p = F.col("knots"), F.col("pieces")
    return graph(spark, sf).edges.select("arc_id", F.round(T.value_at(k, t), 6).alias("travel"), F.round(T.arrival_at(k, t), 6).alias("arrival"), T.min_value(k).alias("least"), T.score_at(p, t).alias("score"), T.score_max(p).alias("best"), F.round(T.latest_departure(k, F.lit(600.0)), 6).alias("latest"))


def e1_edge_summary(spark, sf):
    g = graph(spark, sf)
    s = g.scores.groupBy("arc_id").agg(F.max("score").alias("best"), F.sum((F.col("score") > 0).cast("long")).alias("n_positive"))
    return g.knots.groupBy("arc_id").agg(F.min("tau").alias("least"), F.max("tau").alias("most"), F.min("t").alias("support_from"), F.max("t").alias("support_to")).join(s, "arc_id")


def e2_partition(spark, sf):
    """Cells of five nodes: arcs inside, arcs that leave, and nodes at the border."""
    x = graph(spark, sf).edges.withColumn("cell", F.floor((F.col("u") - 1) / 5)).withColumn("to", F.floor((F.col("v") - 1) / 5))
    return x.groupBy("cell").agg(F.sum((F.col("cell") == F.col("to")).cast("long")).alias("inside"), F.sum((F.col("cell") != F.col("to")).cast("long")).alias("leaving"), F.count_distinct(F.when(F.col("cell") != F.col("to"), F.col("u"))).alias("border"))


def g3_cell_top_scores(spark, sf):
    g = graph(spark, sf)
    from pyspark.sql.window import Window

    x = g.scores.where("score > 0 and t0 < 660 and t1 > 420").groupBy("arc_id").agg(F.max("score").alias("best")).join(g.edges.select("arc_id", "u"), "arc_id").withColumn("cell", F.floor((F.col("u") - 1) / 5))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy(F.col("best").desc(), "arc_id")).cast("long")).where("rank <= 2").select("cell", "arc_id", "best", "rank")


def i1_lower_bounds(spark, sf):
    return _bounds(spark, sf).select("query_id", F.col("node").cast("int").alias("node"), "from_src", "to_dst")


def i2_cell_labels(spark, sf):
    """Least labels with their last arcs, over cells of five nodes whose borders exchange labels."""
    g = graph(spark, sf)
    cells = C.by_number(g.edges.select(F.col("u").alias("node")).union(g.edges.select("v")).distinct(), 5)
    out = P.lower_bounds(g.edges, g.queries.select("query_id", F.col("src").alias("node"), "b"), True, cells)
    return out.select("query_id", "node", "cost", "hops", "arc_id")


def i3_bounds_without_arcs(spark, sf):
    """Each query without a fifth of the arcs, its own."""
    g = graph(spark, sf)
    barred = g.queries.select("query_id").join(g.edges.select("arc_id"), F.col("arc_id") % 5 == F.col("query_id"))
    return P.both_bounds(g.edges, g.queries, without=barred).select("query_id", "node", "from_src", "to_dst")


def i4_corridor(spark, sf):
    g = graph(spark, sf)
    return P.corridor(g.edges, g.queries, _bounds(spark, sf))


def i7_paths(spark, sf):
    return _profiles(spark, sf).select("query_id", _text(), "cost")


def i13_point_labels(spark, sf):
    g = graph(spark, sf)
    out = P.point_labels(g.edges, g.queries, A.grid(g.queries, 10))
    return out.select("query_id", "t", F.col("node").cast("int").alias("node"), F.round("arrival", 6).alias("arrival"))


def i14_latest_labels(spark, sf):
    g = graph(spark, sf)
    out = P.latest_labels(g.edges, g.queries, g.queries.select("query_id", F.col("te").alias("deadline")))
    return out.select("query_id", "deadline", "node", F.round("departure", 6).alias("departure"))


def i10_profile_at_grid(spark, sf):
    """Exact profiles read at grid departures: arrival and score of every feasible path."""
    g = graph(spark, sf)
    at = F.col("t").cast("double")
    x = _profiles(spark, sf).where("size(path) > 0").join(_grid(g.queries), "query_id").join(g.queries.select("query_id", "b"), "query_id")
    x = x.select("query_id", "t", "b", _text(), F.round(T.value_at(F.col("arrival"), at), 6).alias("arrival"), T.score_at(F.col("pieces"), at).alias("score"))
    return x.where("arrival - t <= b").drop("b")


def i12_replay(spark, sf):
    """The same by walking each path at each departure."""
    g = graph(spark, sf)
    x = _profiles(spark, sf).where("size(path) > 0").select("query_id", "path").join(_grid(g.queries), "query_id").join(g.queries.select("query_id", "b"), "query_id")
    y = P.replay_at(g.edges, x).withColumn("arrival", F.round("arrival", 6)).where("arrival - t <= b")
    return y.select("query_id", "t", _text(), "arrival", "score")


def c14_envelope_at_grid(spark, sf):
    """Best path at grid departures, read from the exact envelope."""
    g = graph(spark, sf)
    return E.at_points(E.merge_segments(_won(spark, sf)), _grid(g.queries)).where("path is not null and size(path) > 0").select("query_id", "t", _text())


def c16_fastest_at_grid(spark, sf):
    g = graph(spark, sf)
    return E.at_points(E.merge_segments(_won(spark, sf, True)), _grid(g.queries)).where("path is not null and size(path) > 0").select("query_id", "t", _text())


def c14_envelope(spark, sf):
    return flagship(spark, sf)


def c16_fastest_envelope(spark, sf):
    return E.merge_segments(_won(spark, sf, True)).select("query_id", "s", "e", "s_inc", "e_inc", _text())


def c7_undominated(spark, sf):
    return E.undominated(_covered(spark, sf)).groupBy("query_id").agg(F.count("*").alias("n"))


def c8_retained(spark, sf):
    return E.retain(E.cell_integrals(_covered(spark, sf), graph(spark, sf).queries), 4).groupBy("query_id", "role").agg(F.count("*").alias("n"))


def e4_metrics(spark, sf):
    return E.metrics(_won(spark, sf))


def e5_agreement(spark, sf):
    """The fastest paths against the best ones."""
    return E.quality(_won(spark, sf, True), _won(spark, sf))


def b33_horizon(spark, sf):
    g = graph(spark, sf)
    return P.horizon_ok(g.edges, g.queries.union(g.queries.selectExpr("query_id + 100", "src", "dst", "ts + 2400", "te + 2400", "b")))


def i23_best_point(spark, sf):
    """Best departure of the grid: by score, travel, departure, path."""
    x = i10_profile_at_grid(spark, sf)
    return x.groupBy("query_id").agg(F.min_by(F.struct("t", "path", "score", (F.col("arrival") - F.col("t")).alias("travel")), F.struct((-F.col("score")).alias("a"), F.round(F.col("arrival") - F.col("t"), 6).alias("b"), "t", "path")).alias("m")).select("query_id", "m.t", "m.path", "m.score", F.round("m.travel", 6).alias("travel"))


def i27_first_paths(spark, sf):
    """The three cheapest paths by lower bound."""
    from pyspark.sql.window import Window

    x = _profiles(spark, sf).select("query_id", _text(), "cost", F.size("path").alias("n"), F.col("path").alias("_p"))
    return x.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("cost", "n", "path")).cast("long")).where("k <= 3").select("query_id", "path", "cost", "k")


def g1_pivots(spark, sf):
    g = graph(spark, sf)
    return A.pivots(g, g.queries, P.corridor(g.edges, g.queries, _bounds(spark, sf)), 4)


def i26_all_sampled(spark, sf):
    """Every query: also those whose last departure is off the grid or that start where they end."""
    g = graph(spark, sf)
    return A.answer("sampled", g, g.queries).select("query_id", "s", "e", "s_inc", "e_inc", _text())


def demo_envelope(spark, sf):
    g = demo(spark)
    return E.envelope(P.profiles(g.edges, g.queries), g.queries).select("query_id", "s", "e", "s_inc", "e_inc", _text())


# Walks with bounded cost, each (node, cost) once, and loopless paths with their arrivals at given departures.
_WALKS = """,
fw(query_id, node, c, b) AS (SELECT query_id, src, 0.0::double, b FROM qs UNION SELECT f.query_id, e.v, f.c + l.lb, f.b FROM fw f JOIN edges e ON e.u = f.node JOIN lows l ON l.arc_id = e.arc_id WHERE f.c + l.lb <= f.b),
rw(query_id, node, c, b) AS (SELECT query_id, dst, 0.0::double, b FROM qs UNION SELECT f.query_id, e.u, f.c + l.lb, f.b FROM rw f JOIN edges e ON e.v = f.node JOIN lows l ON l.arc_id = e.arc_id WHERE f.c + l.lb <= f.b),
bnd AS (SELECT f.query_id, f.node, f.c AS from_src, r.c AS to_dst FROM (SELECT query_id, node, min(c) AS c FROM fw GROUP BY 1, 2) f JOIN (SELECT query_id, node, min(c) AS c FROM rw GROUP BY 1, 2) r USING (query_id, node))"""
_ENUM = _WALKS + """,
pth AS (SELECT query_id, src AS node, dst, b, CAST([] AS int[]) AS path, [src] AS nodes, 0.0::double AS cost FROM qs WHERE src <> dst
  UNION ALL SELECT p.query_id, e.v, p.dst, p.b, list_append(p.path, e.arc_id), list_append(p.nodes, e.v), p.cost + l.lb FROM pth p JOIN edges e ON e.u = p.node JOIN lows l ON l.arc_id = e.arc_id JOIN bnd d ON d.query_id = p.query_id AND d.node = e.v
  WHERE p.node <> p.dst AND NOT list_contains(p.nodes, e.v) AND p.cost + l.lb + d.to_dst <= p.b),
full_p AS (SELECT query_id, path, cost FROM pth WHERE node = dst)"""
_AT = _ENUM + """,
dep AS (SELECT query_id, unnest(range(ts, te + 1, 10)) AS t, b FROM qs),
rep AS (SELECT f.query_id, d.t, d.b, f.path, 1 AS i, d.t::double AS a, 0::bigint AS score FROM full_p f JOIN dep d USING (query_id)
  UNION ALL SELECT r.query_id, r.t, r.b, r.path, r.i + 1, r.a + k.tau + (n.tau - k.tau) * (r.a - k.t) / 120, r.score + s.score
  FROM rep r JOIN knots k ON k.arc_id = r.path[r.i] AND k.k = CAST(floor(r.a / 120) AS int) JOIN knots n ON n.arc_id = k.arc_id AND n.k = k.k + 1 JOIN scores s ON s.arc_id = k.arc_id AND s.k = k.k WHERE r.i <= len(r.path)),
got AS (SELECT query_id, t, array_to_string(path, '-') AS path, len(path) AS n, path AS p, round(a, 6) AS arrival, score FROM rep WHERE i = len(path) + 1 AND round(a, 6) - t <= b)"""

_WITH_END = _AT.replace("unnest(range(ts, te + 1, 10)) AS t", "unnest(list_distinct(list_append(range(ts, te + 1, 10), te))) AS t")

SQL = {
    "a14_graph_counts": sql(" SELECT count(*) AS arcs, count(DISTINCT u) AS tails, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM scores s WHERE s.arc_id = e.arc_id AND score > 0) THEN 1 ELSE 0 END) AS bigint) AS scored, CAST(0 AS bigint) AS not_fifo FROM edges e"),
    "b_edge_functions": sql(""" SELECT e.arc_id, round(k.tau + (n.tau - k.tau) * 7.5 / 120, 6) AS travel, round(487.5 + k.tau + (n.tau - k.tau) * 7.5 / 120, 6) AS arrival, l.lb AS least, s.score, (SELECT max(score) FROM scores x WHERE x.arc_id = e.arc_id) AS best,
(SELECT round(max(CASE WHEN b.t + b.tau <= 600 THEN b.t WHEN a.t + a.tau <= 600 THEN a.t + (600 - a.t - a.tau) * 120 / (120 + b.tau - a.tau) END), 6) FROM knots a JOIN knots b ON b.arc_id = a.arc_id AND b.k = a.k + 1 WHERE a.arc_id = e.arc_id) AS latest
FROM edges e JOIN knots k ON k.arc_id = e.arc_id AND k.k = 4 JOIN knots n ON n.arc_id = e.arc_id AND n.k = 5 JOIN scores s ON s.arc_id = e.arc_id AND s.k = 4 JOIN lows l ON l.arc_id = e.arc_id"""),
    "e1_edge_summary": sql(" SELECT k.*, best, n_positive FROM (SELECT arc_id, min(tau) AS least, max(tau) AS most, min(t) AS support_from, max(t) AS support_to FROM knots GROUP BY 1) k JOIN (SELECT arc_id, max(score) AS best, CAST(sum(CASE WHEN score > 0 THEN 1 ELSE 0 END) AS bigint) AS n_positive FROM scores GROUP BY 1) s USING (arc_id)"),
    "e2_partition": sql(" SELECT cell, CAST(sum(CASE WHEN cell = z THEN 1 ELSE 0 END) AS bigint) AS inside, CAST(sum(CASE WHEN cell <> z THEN 1 ELSE 0 END) AS bigint) AS leaving, count(DISTINCT CASE WHEN cell <> z THEN u END) AS border FROM (SELECT u, CAST((u - 1) // 5 AS bigint) AS cell, (v - 1) // 5 AS z FROM edges) GROUP BY cell"),
    "g3_cell_top_scores": sql(" SELECT * FROM (SELECT CAST((u - 1) // 5 AS bigint) AS cell, arc_id, best, row_number() OVER (PARTITION BY (u - 1) // 5 ORDER BY best DESC, arc_id) AS rank FROM (SELECT arc_id, max(score) AS best FROM scores WHERE score > 0 AND t0 < 660 AND t1 > 420 GROUP BY 1) JOIN edges USING (arc_id)) WHERE rank <= 2"),
    "i1_lower_bounds": sql(_WALKS + " SELECT query_id, node, from_src, to_dst FROM bnd", True),
    "i2_cell_labels": sql(""", fw(query_id, node, c, h, a, b) AS (SELECT query_id, src, 0.0::double, 0, -1, b FROM qs UNION SELECT f.query_id, e.v, f.c + l.lb, f.h + 1, e.arc_id, f.b FROM fw f JOIN edges e ON e.u = f.node JOIN lows l ON l.arc_id = e.arc_id WHERE f.c + l.lb <= f.b)
SELECT query_id, node, c AS cost, h AS hops, a AS arc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node ORDER BY c, h, a) AS k FROM fw) WHERE k = 1""", True),
    "i3_bounds_without_arcs": sql(_WALKS.replace("WHERE f.c", "WHERE e.arc_id % 5 <> f.query_id AND f.c") + " SELECT query_id, node, from_src, to_dst FROM bnd", True),
    "i4_corridor": sql(_WALKS + " SELECT q.query_id, e.arc_id, q.b - a.from_src - l.lb - z.to_dst AS slack FROM qs q JOIN bnd a ON a.query_id = q.query_id JOIN edges e ON e.u = a.node JOIN lows l ON l.arc_id = e.arc_id JOIN bnd z ON z.query_id = q.query_id AND z.node = e.v WHERE e.u <> e.v AND q.b - a.from_src - l.lb - z.to_dst >= 0", True),
    "i7_paths": sql(_ENUM + " SELECT query_id, array_to_string(path, '-') AS path, cost FROM full_p UNION ALL SELECT query_id, '', 0.0 FROM qs WHERE src = dst", True),
    "i27_first_paths": sql(_ENUM + " SELECT query_id, path, cost, k FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cost, n, path) AS k FROM (SELECT query_id, array_to_string(path, '-') AS path, len(path) AS n, cost FROM full_p UNION ALL SELECT query_id, '', 0, 0.0 FROM qs WHERE src = dst)) WHERE k <= 3", True),
    "i13_point_labels": sql(""", seg AS (SELECT a.arc_id, a.t AS t0, a.tau AS v0, b.t AS t1, b.tau AS v1 FROM knots a JOIN knots b ON b.arc_id = a.arc_id AND b.k = a.k + 1),
lab(query_id, t, b, node, nodes, arrival) AS (SELECT query_id, unnest(list_distinct(list_append(range(ts, te + 1, 10), te))) AS t, b, src, [src], CAST(t AS double) FROM qs
  UNION ALL SELECT l.query_id, l.t, l.b, e.v, list_append(l.nodes, e.v), l.arrival + v0 + (v1 - v0) * (l.arrival - t0) / 120 FROM lab l JOIN edges e ON e.u = l.node JOIN seg s ON s.arc_id = e.arc_id AND s.t0 <= l.arrival AND l.arrival < s.t1 WHERE NOT list_contains(l.nodes, e.v) AND l.arrival + v0 + (v1 - v0) * (l.arrival - t0) / 120 <= l.t + l.b)
SELECT query_id, t, node, round(min(arrival), 6) AS arrival FROM lab GROUP BY ALL""", True),
    "i14_latest_labels": sql(""", seg AS (SELECT a.arc_id, a.t AS t0, a.t + a.tau AS a0, b.t AS t1, b.t + b.tau AS a1 FROM knots a JOIN knots b ON b.arc_id = a.arc_id AND b.k = a.k + 1),
lab(query_id, deadline, b, node, nodes, departure) AS (SELECT query_id, te, b, dst, [dst], CAST(te AS double) FROM qs
  UNION ALL SELECT l.query_id, l.deadline, l.b, e.u, list_append(l.nodes, e.u), t0 + (l.departure - a0) * 120 / (a1 - a0) FROM lab l JOIN edges e ON e.v = l.node JOIN seg s ON s.arc_id = e.arc_id AND s.a0 <= l.departure AND l.departure < s.a1 WHERE NOT list_contains(l.nodes, e.u) AND t0 + (l.departure - a0) * 120 / (a1 - a0) >= l.deadline - l.b)
SELECT query_id, deadline, node, round(max(departure), 6) AS departure FROM lab GROUP BY ALL""", True),
    "i10_profile_at_grid": sql(_AT + " SELECT query_id, t, path, arrival, score FROM got", True),
    "i12_replay": sql(_AT + " SELECT query_id, t, path, arrival, score FROM got", True),
    "c14_envelope_at_grid": sql(_AT + " SELECT query_id, t, path FROM (SELECT *, row_number() OVER (PARTITION BY query_id, t ORDER BY score DESC, arrival, n, p) AS k FROM got) WHERE k = 1", True),
    "c16_fastest_at_grid": sql(_AT + " SELECT query_id, t, path FROM (SELECT *, row_number() OVER (PARTITION BY query_id, t ORDER BY arrival, n, p) AS k FROM got) WHERE k = 1", True),
    "i23_best_point": sql(_AT + " SELECT query_id, t, path, score, round(arrival - t, 6) AS travel FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, round(arrival - t, 6), t, path) AS k FROM got) WHERE k = 1", True),
    "g1_pivots": sql(_WALKS + """, cor AS (SELECT q.query_id, q.ts, q.te, q.b, e.arc_id, q.b - a.from_src - l.lb - z.to_dst AS slack FROM qs q JOIN bnd a ON a.query_id = q.query_id JOIN edges e ON e.u = a.node JOIN lows l ON l.arc_id = e.arc_id JOIN bnd z ON z.query_id = q.query_id AND z.node = e.v WHERE e.u <> e.v),
x AS (SELECT query_id, arc_id, slack, max(score) AS best, CAST(sum(least(t1, te + b) - greatest(t0, ts)) AS double) AS covered FROM cor JOIN scores USING (arc_id) WHERE slack >= 0 AND score > 0 AND greatest(t0, ts) < least(t1, te + b) GROUP BY 1, 2, 3)
SELECT query_id, arc_id, best, covered, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, covered DESC, slack DESC, arc_id) AS rank FROM x) WHERE rank <= 4""", True),
    "i26_all_sampled": sql(_WITH_END + """, won AS (SELECT query_id, t, path FROM (SELECT *, row_number() OVER (PARTITION BY query_id, t ORDER BY score DESC, arrival, n, p) AS k FROM got) WHERE k = 1 UNION ALL SELECT query_id, t, '' FROM dep JOIN qs USING (query_id) WHERE src = dst)
SELECT query_id, t::double AS s, coalesce(lead(t) OVER w, t)::double AS e, true AS s_inc, lead(t) OVER w IS NULL AS e_inc, path FROM (SELECT DISTINCT query_id, t FROM dep) LEFT JOIN won USING (query_id, t) WINDOW w AS (PARTITION BY query_id ORDER BY t)""", True),
    "b33_horizon": sql(" SELECT query_id, CASE WHEN te + b <= 2880 THEN 'OK' ELSE 'OUT_OF_HORIZON' END AS status FROM (SELECT query_id, te, b FROM qs UNION ALL SELECT query_id + 100, te + 2400, b FROM qs)"),
    "demo_envelope": "SELECT 0 AS query_id, 420.0::double AS s, 430.0::double AS e, true AS s_inc, true AS e_inc, '0-1' AS path",
}
QUERIES = {f.__name__: f for f in (a14_graph_counts, b_edge_functions, e1_edge_summary, e2_partition, g3_cell_top_scores, i1_lower_bounds, i2_cell_labels, i3_bounds_without_arcs, i4_corridor, i7_paths, i13_point_labels, i14_latest_labels, i10_profile_at_grid, i12_replay, c14_envelope_at_grid, c16_fastest_at_grid, c14_envelope, c16_fastest_envelope, c7_undominated, c8_retained, e4_metrics, e5_agreement, b33_horizon, i23_best_point, i27_first_paths, g1_pivots, i26_all_sampled, demo_envelope)}
