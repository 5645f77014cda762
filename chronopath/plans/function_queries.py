"""Queries that put the temporal functions to work on every arc of the derived graph, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopath.functions import temporal as T
from chronopath.plans.temporal_graph import graph, sql

_L = F.lit


def K():
    return F.col("knots")


def P():
    return F.col("pieces")


def _edges(spark, sf):
    return graph(spark, sf).edges


def _pairs(spark, sf):
    """Each arc with the arc of the next number."""
    e = _edges(spark, sf)
    return e.join(e.select((F.col("arc_id") - 1).alias("arc_id"), F.col("knots").alias("knots2"), F.col("pieces").alias("pieces2")), "arc_id")


def _rows(df, array):
    return df.select("arc_id", F.explode(array).alias("x"))


def _t(df):
    """With departures every 37 minutes of the first 43 hours."""
    return df.withColumn("t", F.explode(F.sequence(_L(0), _L(2600), _L(37)))).withColumn("t", F.col("t").cast("double"))


def _early(knots):
    return T.restrict(knots, _L(0.0), _L(2640.0))


def b1_canonical(spark, sf):
    """Times to 12 decimals, ties to even."""
    x = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_partkey").cast("decimal(20,0)") * 1000003 % 10**7).cast("decimal(10,0)").alias("m"))
    return x.select("p_partkey", (T.canonical(F.col("m").cast("decimal(38,18)") / F.lit(10**13).cast("decimal(15,0)")) * F.lit(10**12).cast("decimal(14,0)")).cast("long").alias("ticks"))


def b2_same_time(spark, sf):
    x = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_partkey") % 60).cast("double").alias("a"))
    return x.select("p_partkey", T.same_time(F.col("a") / 60 * 60, F.col("a")).alias("same"), T.same_time(F.col("a"), F.col("a") + (F.col("p_partkey") % 3) * 1e-9).alias("apart"))


def b7_fifo(spark, sf):
    """Suppliers as arcs whose travel times do overtake: whether none does, and on how many stretches."""
    x = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("arc"), (F.col("l_orderkey") % 24 * 10).cast("double").alias("t")).agg(F.max("l_quantity").cast("double").alias("v"))
    k = x.groupBy("arc").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("knots"))  # at most 24 knots each
    return k.select("arc", T.is_fifo(F.col("knots")).alias("fifo"), F.size(F.filter(T.segments(F.col("knots")), lambda s: s["t1"] + s["v1"] < s["t0"] + s["v0"])).cast("long").alias("n_violations"))


def b8_restrict(spark, sf):
    return _rows(_edges(spark, sf), T.restrict(K(), _L(150.0), _L(500.0))).select("arc_id", "x.t", F.round("x.v", 6).alias("v"))


def b9_arrival_by(spark, sf):
    return _rows(_edges(spark, sf), T.arrival_at_most(K(), _L(600.0))).select("arc_id", "x.s", F.round("x.e", 6).alias("e"))


def b11_score_max_on(spark, sf):
    e = _edges(spark, sf)
    return e.select("arc_id", T.score_max(P(), _L(130.0), _L(370.0)).alias("inner"), T.score_max(P(), _L(240.0), _L(240.0)).alias("at_cut"), T.score_max(P(), _L(2880.0), _L(2880.0)).alias("at_end"))


def b12_positive_domain(spark, sf):
    return _rows(_edges(spark, sf), T.positive_domain(P())).select("arc_id", "x.s", "x.e")


def b12_positive_in(spark, sf):
    return _edges(spark, sf).select("arc_id", T.positive_in(P(), _L(300.0), _L(500.0)).alias("positive"))


def b13_score_add(spark, sf):
    return _rows(_pairs(spark, sf), T.score_add(P(), F.col("pieces2"))).select("arc_id", "x.t0", "x.t1", "x.score")


def b14_score_compose(spark, sf):
    """Score of the next arc when it is entered behind this one."""
    x = _t(_pairs(spark, sf).withColumn("c", T.score_compose(F.col("pieces2"), T.to_arrival(_early(K())))))
    return x.select("arc_id", "t", T.score_at(F.col("c"), F.col("t")).alias("score"))


def b15_one_sided(spark, sf):
    """Score at an instant and just before it."""
    x = _edges(spark, sf).withColumn("t", F.explode(F.array(*[_L(float(t)) for t in (0, 60, 120, 240, 2880)])))
    return x.select("arc_id", "t", T.score_at(P(), F.col("t")).alias("at"), F.coalesce(T.score_before(P(), F.col("t")), _L(-1)).alias("before"))


def b16_compose(spark, sf):
    x = _t(_pairs(spark, sf).withColumn("c", T.compose(T.to_arrival(F.col("knots2")), T.to_arrival(_early(K())))))
    return x.select("arc_id", "t", F.round(T.value_at(F.col("c"), F.col("t")), 6).alias("arrival"))


def b17_preimage(spark, sf):
    """Departures that arrive within [600, 700]."""
    x = _edges(spark, sf).select("arc_id", T.preimage(T.to_arrival(K()), _L(600.0), _L(700.0)).alias("x"))
    return x.select("arc_id", F.round("x.s", 6).alias("s"), F.round("x.e", 6).alias("e"))


def b18_image(spark, sf):
    x = _edges(spark, sf).select("arc_id", T.image(T.to_arrival(T.restrict(K(), _L(150.0), _L(500.0)))).alias("x"))
    return x.select("arc_id", F.round("x.lo", 6).alias("lo"), F.round("x.hi", 6).alias("hi"))


def b19_budget_domain(spark, sf):
    return _rows(_edges(spark, sf), T.travel_at_most(T.to_arrival(K()), F.col("lb") + 4)).select("arc_id", F.round("x.s", 6).alias("s"), F.round("x.e", 6).alias("e"))


def b20_pointwise_min(spark, sf):
    x = _t(_pairs(spark, sf).withColumn("c", T.pointwise_min(K(), F.col("knots2"))))
    return x.select("arc_id", "t", F.round(T.value_at(F.col("c"), F.col("t")), 6).alias("least"))


def b21_order(spark, sf):
    k2 = F.col("knots2")
    return _pairs(spark, sf).select("arc_id", T.no_later_than(K(), k2).alias("no_later"), T.same_values(K(), k2).alias("same"))


def b22_extremes_on(spark, sf):
    x = T.restrict(K(), _L(150.0), _L(500.0))
    return _edges(spark, sf).select("arc_id", F.round(T.min_value(x), 6).alias("least"), F.round(T.max_value(x), 6).alias("most"))


def b23_compact(spark, sf):
    """Knots that bend, after middles of all segments were put in."""
    middle = F.transform(T.segments(K()), lambda s: F.struct(((s["t0"] + s["t1"]) / 2).alias("t"), ((s["v0"] + s["v1"]) / 2).alias("v")))
    return _rows(_edges(spark, sf), T.compact(F.array_sort(F.concat(K(), middle)))).select("arc_id", "x.t", "x.v")


def b25_score_restrict(spark, sf):
    return _rows(_edges(spark, sf), T.score_restrict(P(), _L(130.0), _L(370.0))).select("arc_id", "x.t0", "x.t1", "x.score")


def b27_thin(spark, sf):
    return _edges(spark, sf).select("arc_id", F.size(T.thin(K(), 3)).cast("long").alias("n"), F.round(T.thinning_error(K(), 3), 6).alias("error"))


def b29_grid(spark, sf):
    return graph(spark, sf).queries.select("query_id", F.explode(T.grid(F.col("ts").cast("long"), F.col("te").cast("long"), _L(7).cast("long"))).alias("t"))


def b30_loopless(spark, sf):
    """Whether an order's lines, as a walk over suppliers, meet none twice."""
    x = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("nodes"))  # at most seven lines
    return x.select("l_orderkey", T.loopless(F.col("nodes")).alias("simple"))


def e7_absolute_gap(spark, sf):
    """Integral of the absolute difference between an arc's travel time and the next arc's."""
    x = _pairs(spark, sf).select("arc_id", F.posexplode(F.transform(K(), lambda k, i: (k["v"] - F.get(F.col("knots2"), i)["v"]))).alias("k", "d"))
    y = x.join(x.select("arc_id", (F.col("k") - 1).alias("k"), F.col("d").alias("d1")), ["arc_id", "k"])
    return y.groupBy("arc_id").agg(F.round(F.sum(T.abs_linear_integral(F.col("d"), F.col("d1"), _L(120.0))), 4).alias("gap"))


_SEG = ", seg AS (SELECT a.arc_id, a.k, a.t AS t0, a.tau AS v0, b.t AS t1, b.tau AS v1 FROM knots a JOIN knots b ON b.arc_id = a.arc_id AND b.k = a.k + 1)"
_AT = _SEG + ", dep AS (SELECT CAST(unnest(range(0, 2601, 37)) AS double) AS t), val AS (SELECT arc_id, t, v0 + (v1 - v0) * (t - t0) / 120 AS v FROM seg JOIN dep ON t0 <= t AND t < t1)"
_CUT = _SEG + ", cut AS (SELECT arc_id, t, tau AS v FROM knots WHERE t > 150 AND t < 500 UNION ALL SELECT arc_id, p, v0 + (v1 - v0) * (p - t0) / 120 FROM seg JOIN (VALUES (150.0::double), (500.0::double)) x(p) ON t0 <= p AND p < t1)"

SQL = {
    "b1_canonical": "WITH x AS (SELECT p_partkey, CAST(p_partkey AS bigint) * 1000003 % 10000000 AS m FROM part) SELECT p_partkey, CAST(m // 10 + CASE WHEN m % 10 > 5 OR (m % 10 = 5 AND (m // 10) % 2 = 1) THEN 1 ELSE 0 END AS bigint) AS ticks FROM x",
    "b2_same_time": "SELECT p_partkey, true AS same, p_partkey % 3 = 0 AS apart FROM part",
    "b7_fifo": "WITH x AS (SELECT l_suppkey AS arc, l_orderkey % 24 * 10 AS t, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2), y AS (SELECT arc, t + v < lag(t + v) OVER (PARTITION BY arc ORDER BY t) AS bad FROM x) SELECT arc, NOT bool_or(coalesce(bad, false)) AS fifo, count(CASE WHEN bad THEN 1 END) AS n_violations FROM y GROUP BY 1",
    "b8_restrict": sql(_CUT + " SELECT arc_id, t, round(v, 6) AS v FROM cut"),
    "b9_arrival_by": sql(_SEG + " SELECT arc_id, t0 AS s, round(CASE WHEN t1 + v1 <= 600 THEN t1 ELSE t0 + (600 - t0 - v0) * 120 / (120 + v1 - v0) END, 6) AS e FROM seg WHERE t0 + v0 <= 600"),
    "b11_score_max_on": sql(" SELECT arc_id, max(CASE WHEN t0 <= 370 AND t1 > 130 THEN score END) AS inner, max(CASE WHEN t0 = 240 THEN score END) AS at_cut, max(CASE WHEN t1 = 2880 THEN score END) AS at_end FROM scores GROUP BY 1"),
    "b12_positive_domain": sql(", g AS (SELECT arc_id, t0, t1, k - row_number() OVER (PARTITION BY arc_id ORDER BY k) AS g FROM scores WHERE score > 0) SELECT arc_id, CAST(min(t0) AS double) AS s, CAST(max(t1) AS double) AS e FROM g GROUP BY arc_id, g"),
    "b12_positive_in": sql(" SELECT arc_id, bool_or(score > 0 AND t0 < 500 AND t1 > 300) AS positive FROM scores GROUP BY 1"),
    "b13_score_add": sql(" SELECT a.arc_id, CAST(a.t0 AS double) AS t0, CAST(a.t1 AS double) AS t1, a.score + b.score AS score FROM scores a JOIN scores b ON b.arc_id = a.arc_id + 1 AND b.k = a.k"),
    "b14_score_compose": sql(_AT + " SELECT v.arc_id, v.t, s.score FROM val v JOIN scores s ON s.arc_id = v.arc_id + 1 AND s.t0 <= v.t + v.v AND v.t + v.v < s.t1"),
    "b15_one_sided": sql(" SELECT e.arc_id, x.t, a.score AS at, coalesce(b.score, -1) AS before FROM edges e CROSS JOIN (SELECT CAST(unnest([0, 60, 120, 240, 2880]) AS double) AS t) x LEFT JOIN scores a ON a.arc_id = e.arc_id AND a.t0 <= x.t AND (x.t < a.t1 OR x.t = 2880 AND a.t1 = 2880) LEFT JOIN scores b ON b.arc_id = e.arc_id AND b.t0 < x.t AND x.t <= b.t1"),
    "b16_compose": sql(_AT + " SELECT v.arc_id, v.t, round(v.t + v.v + s.v0 + (s.v1 - s.v0) * (v.t + v.v - s.t0) / 120, 6) AS arrival FROM val v JOIN seg s ON s.arc_id = v.arc_id + 1 AND s.t0 <= v.t + v.v AND v.t + v.v < s.t1"),
    "b17_preimage": sql(_SEG + " SELECT arc_id, round(min(CASE WHEN t0 + v0 >= 600 THEN t0 WHEN t1 + v1 >= 600 THEN t0 + (600 - t0 - v0) * 120 / (120 + v1 - v0) END), 6) AS s, round(max(CASE WHEN t1 + v1 <= 700 THEN t1 WHEN t0 + v0 <= 700 THEN t0 + (700 - t0 - v0) * 120 / (120 + v1 - v0) END), 6) AS e FROM seg GROUP BY 1"),
    "b18_image": sql(_CUT + " SELECT arc_id, round(min(t + v), 6) AS lo, round(max(t + v), 6) AS hi FROM cut GROUP BY 1"),
    "b19_budget_domain": sql(_SEG + ", c AS (SELECT s.*, l.lb + 4 AS b FROM seg s JOIN lows l USING (arc_id)) SELECT arc_id, round(CASE WHEN v0 <= b THEN t0 ELSE t0 + (b - v0) * 120 / (v1 - v0) END, 6) AS s, round(CASE WHEN v1 <= b THEN t1 ELSE t0 + (b - v0) * 120 / (v1 - v0) END, 6) AS e FROM c WHERE v0 <= b OR v1 <= b"),
    "b20_pointwise_min": sql(" SELECT e.arc_id, CAST(d.t AS double) AS t, round(least(a.tau + (b.tau - a.tau) * (d.t - a.t) / 120, x.tau + (y.tau - x.tau) * (d.t - x.t) / 120), 6) AS least FROM edges e CROSS JOIN (SELECT unnest(range(0, 2601, 37)) AS t) d JOIN knots a ON a.arc_id = e.arc_id AND a.k = d.t // 120 JOIN knots b ON b.arc_id = e.arc_id AND b.k = d.t // 120 + 1 JOIN knots x ON x.arc_id = e.arc_id + 1 AND x.k = d.t // 120 JOIN knots y ON y.arc_id = e.arc_id + 1 AND y.k = d.t // 120 + 1"),
    "b21_order": sql(" SELECT a.arc_id, bool_and(a.tau <= b.tau) AS no_later, bool_and(a.tau = b.tau) AS same FROM knots a JOIN knots b ON b.arc_id = a.arc_id + 1 AND b.k = a.k GROUP BY 1"),
    "b22_extremes_on": sql(_CUT + " SELECT arc_id, round(min(v), 6) AS least, round(max(v), 6) AS most FROM cut GROUP BY 1"),
    "b23_compact": sql(", w AS (SELECT *, lag(tau) OVER o AS p, lead(tau) OVER o AS n FROM knots WINDOW o AS (PARTITION BY arc_id ORDER BY k)) SELECT arc_id, t, tau AS v FROM w WHERE p IS NULL OR n IS NULL OR tau - p <> n - tau"),
    "b25_score_restrict": sql(" SELECT arc_id, CAST(greatest(t0, 130) AS double) AS t0, CAST(least(t1, 370) AS double) AS t1, score FROM scores WHERE t0 < 370 AND t1 > 130"),
    "b27_thin": sql(" SELECT x.arc_id, CAST(9 AS bigint) AS n, round(max(abs(x.tau - a.tau - (b.tau - a.tau) * (x.k - a.k) / 3.0)), 6) AS error FROM knots x JOIN knots a ON a.arc_id = x.arc_id AND a.k = least(x.k // 3 * 3, 21) JOIN knots b ON b.arc_id = x.arc_id AND b.k = a.k + 3 GROUP BY 1"),
    "b29_grid": sql(" SELECT query_id, CAST(unnest(range(ts, te + 1, 7)) AS bigint) AS t FROM qs"),
    "b30_loopless": "SELECT l_orderkey, count(DISTINCT l_suppkey) = count(*) AS simple FROM lineitem GROUP BY 1",
    "e7_absolute_gap": sql(_SEG + ", d AS (SELECT a.arc_id, a.v0 - b.v0 AS x, a.v1 - b.v1 AS y FROM seg a JOIN seg b ON b.arc_id = a.arc_id + 1 AND b.k = a.k) SELECT arc_id, round(sum(CASE WHEN x * y >= 0 THEN abs(x + y) / 2 * 120 ELSE (x * x + y * y) / (abs(x) + abs(y)) / 2 * 120 END), 4) AS gap FROM d GROUP BY 1"),
}
QUERIES = {n: f for n, f in list(globals().items()) if n in SQL}
