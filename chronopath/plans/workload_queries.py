"""Workload, generation and spatial queries, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopath.operators import spatial as S
from chronopath.operators import workload as W
from chronopath.plans.temporal_graph import graph, sql


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _points(spark, sf):
    a = _t(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") * 7919 % 5000).cast("double").alias("ax"), (F.col("s_suppkey") * 104729 % 5000).cast("double").alias("ay"))
    b = _t(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") * 6007 % 5000).cast("double").alias("bx"), (F.col("c_custkey") * 3001 % 5000).cast("double").alias("by"))
    return a, b


def d10_within(spark, sf):
    a, b = _points(spark, sf)
    return S.within(a, b, 150.0, rounded=F.round("distance", 6)).select("s_suppkey", "c_custkey", F.col("rounded").alias("distance"))


def d13_nearest(spark, sf):
    a, b = _points(spark, sf)
    return S.nearest(a, b, "s_suppkey", "c_custkey", 200.0).select("s_suppkey", "c_custkey", F.round("distance", 6).alias("distance"))


def d10_match(spark, sf):
    a, b = _points(spark, sf)
    a, b = a.withColumn("edge_angle", (F.col("s_suppkey") * 37 % 360).cast("double")), b.withColumn("line_angle", (F.col("c_custkey") * 53 % 360).cast("double"))
    return S.match(a, b, 150.0, 45.0).select("s_suppkey", "c_custkey", "match_score")


def d11_ordered_arcs(spark, sf):
    """Suppliers as bent edges along the lines that every twenty customers make."""
    a, b = _points(spark, sf)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ax, ay, k = F.col("ax"), F.col("ay"), F.col("s_suppkey") % 7 - 3
    edges = a.select(F.col("s_suppkey").alias("arc_id"), F.array(point(ax, ay), point(ax + 90, ay + k * 40.0), point(ax + 200, ay + k * 70.0)).alias("points"))
    shapes = b.groupBy(F.floor(F.col("c_custkey") / 20).alias("shape")).agg(F.sort_array(F.collect_list(F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("points"))
    return S.ordered_arcs(edges, shapes, 150.0, 0.2, 60.0, digits=4)


def j8_nested_scores(spark, sf):
    x = _t(spark, sf, "part").select("p_partkey")
    return W.nested_selection(x, "p_partkey", 1009, [50, 200], 389, 71)


def j2_budgets(spark, sf):
    x = _t(spark, sf, "customer").select("c_custkey", (F.abs(F.col("c_acctbal")) / 7).cast("decimal(20,6)").alias("fastest"))
    return W.budgets(x, "fastest", 0.25).select("c_custkey", F.round("budget", 6).alias("budget"))


def j5_bands(spark, sf):
    return W.bands(_t(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"], 7).select("s_suppkey", "band")


def j1_all_candidates(spark, sf):
    """Every customer as a source."""
    c = _t(spark, sf, "customer")
    src = c.select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("cell"))
    dst = c.select(F.col("c_custkey").alias("dst"), F.col("c_nationkey").alias("cell"), "c_acctbal")
    x = W.candidate_pairs(src, dst, 5, 3, F.when(F.col("c_acctbal") < 0, "poor"))
    return x.select("src", F.size("accepted").cast("long").alias("accepted"), F.coalesce(F.col("reasons")["poor"], F.lit(0)).alias("poor"), "seen")


def j14_stratified(spark, sf):
    return W.stratified(_t(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey", 5, 3).groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


def j7_travel_functions(spark, sf):
    x = W.travel_functions(graph(spark, sf).edges.select("arc_id", "w"), 9)
    return x.groupBy("arc_id").agg(F.count("*").alias("knots"), F.min("tau").alias("least"), F.max("tau").alias("most"))


def j10_neighbourhood(spark, sf):
    g = graph(spark, sf)
    _, arcs = W.neighbourhood(g.edges.select("arc_id", "u", "v"), spark.createDataFrame([(1,)], "node int"), 2)
    return arcs.select("arc_id", F.col("new_u").cast("long").alias("new_u"), F.col("new_v").cast("long").alias("new_v"))


_P = "a AS (SELECT s_suppkey, CAST(s_suppkey * 7919 % 5000 AS double) AS ax, CAST(s_suppkey * 104729 % 5000 AS double) AS ay FROM supplier), b AS (SELECT c_custkey, CAST(c_custkey * 6007 % 5000 AS double) AS bx, CAST(c_custkey * 3001 % 5000 AS double) AS bq FROM customer), p AS (SELECT *, sqrt((ax - bx) * (ax - bx) + (ay - bq) * (ay - bq)) AS d FROM a CROSS JOIN b)"
SQL = {
    "d10_within": f"WITH {_P} SELECT s_suppkey, c_custkey, round(d, 6) AS distance FROM p WHERE d <= 150",
    "d13_nearest": f"WITH {_P} SELECT s_suppkey, c_custkey, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY d, c_custkey) AS r FROM p WHERE d <= 200) WHERE r = 1",
    "d10_match": f"WITH {_P}, m AS (SELECT *, abs(((s_suppkey * 37 % 360 - c_custkey * 53 % 360 + 180 + 720) % 360) - 180)::double AS turn FROM p WHERE d <= 150) SELECT s_suppkey, c_custkey, round(0.7 * (1 - d / 150) + 0.3 * (1 - turn / 45), 6) AS match_score FROM m WHERE turn <= 45",
    "j8_nested_scores": "SELECT p_partkey, (389 * p_partkey + 71) % 1009 < 50 AS in_50, (389 * p_partkey + 71) % 1009 < 200 AS in_200 FROM part",
    "j2_budgets": "SELECT c_custkey, round(CAST(ceil(CAST(CAST(abs(c_acctbal) / 7 AS decimal(20, 6)) AS decimal(28, 6)) * 1.25 * 1000000000) AS double) / 1e9, 6) AS budget FROM customer",
    "j5_bands": "WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS r, count(*) OVER () AS n FROM supplier), k AS (SELECT unnest(range(7)) AS b) SELECT s_suppkey, b AS band FROM r JOIN k ON r >= b * n // 7 AND r < (b + 1) * n // 7",
    "j1_all_candidates": "WITH x AS (SELECT s.c_custkey AS src, d.c_custkey AS dst, d.c_acctbal < 0 AND s.c_custkey <> d.c_custkey AS poor FROM customer s JOIN customer d USING (c_nationkey)) SELECT src, least(3, CAST(sum(CASE WHEN NOT poor AND src <> dst THEN 1 ELSE 0 END) AS bigint)) AS accepted, CAST(sum(CASE WHEN poor THEN 1 ELSE 0 END) AS bigint) AS poor, count(*) AS seen FROM x GROUP BY src",
    "j14_stratified": "SELECT o_orderpriority, o_orderstatus, least(5, count(*)) AS n FROM orders GROUP BY 1, 2",
    "j10_neighbourhood": sql(", n0 AS (SELECT 1 AS node), n1 AS (SELECT node FROM n0 UNION SELECT v FROM edges JOIN n0 ON u = node), n2 AS (SELECT node FROM n1 UNION SELECT v FROM edges JOIN n1 ON u = node), m AS (SELECT node, row_number() OVER (ORDER BY node) AS i FROM n2) SELECT arc_id, a.i AS new_u, b.i AS new_v FROM edges JOIN m a ON u = a.node JOIN m b ON v = b.node"),
}
QUERIES = {f.__name__: f for f in (d10_within, d13_nearest, d10_match, d11_ordered_arcs, j8_nested_scores, j2_budgets, j5_bands, j1_all_candidates, j14_stratified, j7_travel_functions, j10_neighbourhood)}
