"""A temporal graph of nations derived from the star schema, in SQL that Spark and other engines share.

Nodes are nations; an arc leads from a supplier's nation to a customer's for each nation's three busiest customers,
and a ring joins all. Travel times are linear between knots two hours apart over two days and never let a later
departure arrive earlier; a third of the arcs has scores, constant for two hours.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STEPS = ", ".join(f"({k})" for k in range(25))
#: source, destination, first and last departure in minutes, budget in minutes
QUERIES = [(0, 1, 12, 420, 450, 75), (1, 6, 18, 475, 500, 70), (2, 11, 24, 590, 620, 75), (3, 16, 5, 1070, 1090, 80), (4, 21, 21, 600, 630, 30)]

CTE = f"""
ks AS (SELECT k FROM (VALUES {_STEPS}) AS x(k)),
qs AS (SELECT * FROM (VALUES {", ".join(map(str, QUERIES))}) AS x(query_id, src, dst, ts, te, b)),
arc_n AS (SELECT s.s_nationkey + 1 AS u, c.c_nationkey + 1 AS v, count(*) AS n, CAST(sum(l.l_quantity) AS bigint) AS q
  FROM {{lineitem}} l JOIN {{supplier}} s ON l.l_suppkey = s.s_suppkey JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey JOIN {{customer}} c ON o.o_custkey = c.c_custkey
  WHERE s.s_nationkey <> c.c_nationkey GROUP BY s.s_nationkey + 1, c.c_nationkey + 1),
arc_r AS (SELECT u, v, q, row_number() OVER (PARTITION BY u ORDER BY n DESC, v) AS rn FROM arc_n),
arc_u AS (SELECT u, v, 5 + q % 20 AS w, 0 AS src FROM arc_r WHERE rn <= 3
  UNION ALL SELECT n_nationkey + 1, (n_nationkey + 1) % 25 + 1, 12, 1 FROM {{nation}}),
edges AS (SELECT CAST(row_number() OVER (ORDER BY u, v, src) - 1 AS int) AS arc_id, CAST(u AS int) AS u, CAST(v AS int) AS v, CAST(w AS double) AS w FROM arc_u),
knots AS (SELECT arc_id, k, CAST(120 * k AS double) AS t, w + (arc_id * 7 + k * k * 5) % 11 AS tau FROM edges CROSS JOIN ks),
scores AS (SELECT arc_id, k, 120 * k AS t0, 120 * (k + 1) AS t1, CAST(CASE WHEN arc_id % 3 = 0 THEN (arc_id * 5 + k * 3) % 16 ELSE 0 END AS bigint) AS score FROM edges CROSS JOIN ks WHERE k < 24),
lows AS (SELECT arc_id, min(tau) AS lb FROM knots GROUP BY arc_id)"""
TABLES = ("lineitem", "supplier", "orders", "customer", "nation")


def sql(tail: str, recursive: bool = False) -> str:
    """The graph's common tables and a query over them, for an engine that has the star schema's tables by name."""
    return ("WITH RECURSIVE" if recursive else "WITH") + CTE.format(**{t: t for t in TABLES}) + tail


@dataclass(frozen=True)
class Graph:
    """``edges(arc_id, u, v, w, lb, knots array<struct<t, v>>, pieces array<struct<t0, t1, score>>)`` and ``queries``."""

    edges: DataFrame
    knots: DataFrame
    scores: DataFrame
    queries: DataFrame


_HELD: dict[tuple[str, str], Graph] = {}


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of a folder of tables; its arcs (a hundred) are kept by the session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _HELD:
        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
        part = lambda name: spark.sql(f"WITH {CTE} SELECT * FROM {name}", **tables)
        base = part("edges").persist()
        steps = spark.range(25).withColumnRenamed("id", "k")
        on = base.crossJoin(F.broadcast(steps))  # 25 knots an arc
        knots = on.select("arc_id", "k", (F.col("k") * 120).cast("double").alias("t"), (F.col("w") + (F.col("arc_id") * 7 + F.col("k") * F.col("k") * 5) % 11).alias("tau")).persist()
        scores = on.where("k < 24").select("arc_id", "k", (F.col("k") * 120).alias("t0"), (F.col("k") * 120 + 120).alias("t1"), F.when(F.col("arc_id") % 3 == 0, (F.col("arc_id") * 5 + F.col("k") * 3) % 16).otherwise(0).cast("long").alias("score")).persist()
        k = knots.groupBy("arc_id").agg(F.sort_array(F.collect_list(F.struct("t", F.col("tau").alias("v")))).alias("knots"), F.min("tau").alias("lb"))
        p = scores.groupBy("arc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("t0").cast("double").alias("t0"), F.col("t1").cast("double").alias("t1"), "score"))).alias("pieces"))
        edges = base.join(k, "arc_id").join(p, "arc_id").persist()
        qs = spark.createDataFrame(QUERIES, "query_id int, src int, dst int, ts int, te int, b int")
        _HELD[key] = Graph(edges, knots, scores, qs)
    return _HELD[key]


def release(spark: SparkSession) -> None:
    """Let go of the graphs that a session keeps."""
    for key in [k for k in _HELD if k[0] == spark.sparkContext.applicationId]:
        g = _HELD.pop(key)
        for df in (g.edges, g.knots, g.scores):
            df.unpersist()


def demo(spark: SparkSession) -> Graph:
    """Five arcs over four nodes with one preferred stretch of time: a graph small enough to check by hand."""
    rows = [(0, 1, 2, 10.0, 8), (1, 2, 4, 10.0, 0), (2, 1, 3, 5.0, 5), (3, 3, 4, 40.0, 0), (4, 1, 4, 25.0, 0)]
    edges = [(a, u, v, w, w, [(0.0, w), (1440.0, w)], [(0.0, 420.0, 0), (420.0, 600.0, s), (600.0, 1440.0, 0)] if s else [(0.0, 1440.0, 0)]) for a, u, v, w, s in rows]
    df = spark.createDataFrame(edges, "arc_id int, u int, v int, w double, lb double, knots array<struct<t: double, v: double>>, pieces array<struct<t0: double, t1: double, score: bigint>>")
    knots = df.select("arc_id", F.posexplode("knots").alias("k", "x")).select("arc_id", "k", "x.t", F.col("x.v").alias("tau"))
    scores = df.select("arc_id", F.posexplode("pieces").alias("k", "x")).select("arc_id", "k", "x.t0", "x.t1", "x.score")
    return Graph(df, knots, scores, spark.createDataFrame([(0, 1, 4, 420, 430, 60)], "query_id int, src int, dst int, ts int, te int, b int"))
