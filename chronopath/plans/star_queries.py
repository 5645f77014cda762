"""Queries over the star schema for the analytics operators, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopath.operators import intervals as I
from chronopath.operators import records as R


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _iv(spark, sf, flag):
    """Intervals of suppliers: from a line's order number on, as long as its quantity."""
    x = _t(spark, sf, "lineitem").where(F.col("l_returnflag") == flag)
    s = (F.col("l_orderkey") % 4000).cast("long")
    return x.select((F.col("l_suppkey") % 40).alias("k"), s.alias("s"), (s + F.col("l_quantity").cast("long")).alias("e"), (F.col("l_linenumber") % 2 == 0).alias("s_inc"), (F.col("l_partkey") % 3 == 0).alias("e_inc"))


def _iv_sql(name, flag):
    return f"{name} AS (SELECT l_suppkey % 40 AS k, l_orderkey % 4000 AS s, l_orderkey % 4000 + CAST(l_quantity AS bigint) AS e, l_linenumber % 2 = 0 AS s_inc, l_partkey % 3 = 0 AS e_inc FROM lineitem WHERE l_returnflag = '{flag}')"


def _merge_sql(src, out):
    return f"""{out}_x AS (SELECT *, max(e * 2 + CASE WHEN e_inc THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, s_inc DESC, e, e_inc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM {src} WHERE s < e OR (s_inc AND e_inc)),
{out}_y AS (SELECT *, sum(CASE WHEN pm IS NULL OR s * 2 > pm OR (s * 2 = pm AND NOT s_inc) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, s_inc DESC, e, e_inc ROWS UNBOUNDED PRECEDING) AS isle FROM {out}_x),
{out}_z AS (SELECT k, isle, min(s * 2 + CASE WHEN s_inc THEN 0 ELSE 1 END) AS a, max(e * 2 + CASE WHEN e_inc THEN 1 ELSE 0 END) AS b FROM {out}_y GROUP BY k, isle),
{out} AS (SELECT k, a // 2 AS s, b // 2 AS e, a % 2 = 0 AS s_inc, b % 2 = 1 AS e_inc FROM {out}_z)"""


def c1_union(spark, sf):
    return I.merge(_iv(spark, sf, "A"), ["k"])


def c2_intersection(spark, sf):
    return I.intersect(I.merge(_iv(spark, sf, "A"), ["k"]), I.merge(_iv(spark, sf, "R"), ["k"]), ["k"])


def c3_difference(spark, sf):
    return I.subtract(I.merge(_iv(spark, sf, "A"), ["k"]), _iv(spark, sf, "R"), ["k"])


def c4_split(spark, sf):
    cuts = _t(spark, sf, "part").select((F.col("p_partkey") % 40).alias("k"), (F.col("p_partkey") * 7 % 4000).alias("cut"))
    return I.split(I.merge(_iv(spark, sf, "A"), ["k"]), cuts, ["k"])


def c5_integer_points(spark, sf):
    return I.integer_points(I.merge(_iv(spark, sf, "N"), ["k"])).groupBy("k").agg(F.count("*").alias("n"), F.sum("t").alias("total"))


def c5_contains(spark, sf):
    pts = _t(spark, sf, "part").select((F.col("p_partkey") % 40).alias("k"), (F.col("p_partkey") % 4000).alias("t"))
    return I.contains(I.merge(_iv(spark, sf, "R"), ["k"]), pts, ["k"])


def e8_nearest_rank(spark, sf):
    x = _t(spark, sf, "lineitem")
    return R.percentiles(x, ["l_returnflag"], "l_extendedprice", {"p25": 0.25, "p95": 0.95})


def e9_interpolated(spark, sf):
    x = _t(spark, sf, "orders")
    y = R.percentiles(x, ["o_orderstatus"], "o_totalprice", between={"p50": 0.5, "p90": 0.9})
    return y.select("o_orderstatus", *[F.round(c, 4).alias(c) for c in ("p50", "p90")])


def e10_iqr(spark, sf):
    y = R.percentiles(_t(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", between={"q1": 0.25, "q3": 0.75})
    return y.select("o_orderpriority", F.round(F.col("q3") - F.col("q1"), 4).alias("iqr"))


def e11_two_level_median(spark, sf):
    x = R.two_level_median(_t(spark, sf, "orders"), ["o_orderpriority"], "o_custkey", "o_totalprice")
    return x.withColumn("median", F.round("median", 4))


def e12_summary(spark, sf):
    x = _t(spark, sf, "events")
    return R.summary(x, ["event_type"], "value", F.col("value") < 20, 20.0)


def e12_histogram(spark, sf):
    return R.histogram(_t(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus")


def e6_weighted_percentile(spark, sf):
    x = _t(spark, sf, "lineitem").withColumn("w", F.col("l_quantity").cast("long"))
    return R.weighted_percentile(x, ["l_returnflag"], "l_extendedprice", "w", 0.5)


def e15_signed_rank(spark, sf):
    x = _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("x"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("y"))
    return R.signed_rank(x.withColumn("g", F.col("l_suppkey") % 3), ["g"], "x", "y").select("g", "n", "w_plus", "w_minus", "effect")


def e15_signed_rank_p(spark, sf):
    x = _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("x"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("y"))
    x = x.withColumn("g", F.col("l_suppkey") % 3)
    alike = x.where("g = 0").withColumn("g", F.lit(9).cast("long")).withColumn("y", F.col("x"))  # a group without a difference
    return R.signed_rank(x.unionByName(alike), ["g"], "x", "y").select("g", "n", "effect", F.coalesce("p", F.lit(-1.0)).alias("p"))


def e14_bootstrap(spark, sf):
    return R.bootstrap_median(_t(spark, sf, "supplier"), ["s_nationkey"], "s_acctbal", "s_suppkey", 200)


def e16_holm(spark, sf):
    x = _t(spark, sf, "supplier").select((F.col("s_suppkey") % 4).alias("g"), "s_suppkey", (F.col("s_suppkey") * 7919 % 1000 / 20000).alias("p"))
    return R.holm(x, ["g"], "p", "s_suppkey").select("g", "s_suppkey", F.round("holm", 6).alias("holm"))


def e17_speedup(spark, sf):
    x = _t(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_extendedprice").alias("v"))
    return R.against_baseline(x, "l_suppkey", "l_linenumber", 1, "v").select("l_suppkey", "l_linenumber", "speedup", "efficiency")


def e20_kaplan_meier(spark, sf):
    x = _t(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("t"), (F.col("l_linestatus") == "F").alias("d"))
    return R.kaplan_meier_median(x, ["l_returnflag"], "t", "d")


def e22_time_bins(spark, sf):
    x = R.time_bins(_t(spark, sf, "events").withColumn("v", F.col("value").cast("string")), ["event_type"], "ts", "v", "60 minutes")
    return x.select("event_type", F.date_format("bin_start", "yyyy-MM-dd HH:mm").alias("bin_start"), F.round("median_value", 6).alias("median_value"), "n", "n_valid")


def e23_diagnostic(spark, sf):
    x = _t(spark, sf, "events")
    return x.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"), F.round(F.avg(F.col("value").isNull().cast("double")), 6).alias("missing"), F.min("value").alias("least"), F.max("value").alias("most"))


def e24_impute(spark, sf):
    x = _t(spark, sf, "customer").withColumn("v", F.when(F.col("c_custkey") % 3 == 0, None).otherwise(F.col("c_acctbal")))
    x = x.withColumn("v", F.when(F.col("c_nationkey") == 7, None).otherwise(F.col("v")))
    y = R.impute(x, "v", [["c_nationkey", "c_mktsegment"], ["c_mktsegment"]], F.lit(0.0))
    return y.select("c_custkey", "source", F.round("filled", 4).alias("filled"))


def e25_capped_distinct(spark, sf):
    x = _t(spark, sf, "lineitem").join(_t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return R.capped_distinct(x, ["l_suppkey"], "p_brand", 15)


def e19_resolve(spark, sf):
    """Of each segment the cheapest nation that meets the bar, else the best of the rest."""
    x = _t(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.avg("c_acctbal").alias("m"), F.count("*").alias("n"))
    meets = F.col("m") >= 4500
    return x.groupBy("c_mktsegment").agg(F.min_by("c_nationkey", F.struct(F.when(meets, 0).otherwise(1).alias("tier"), F.when(meets, F.col("n").cast("double")).otherwise(-F.col("m")).alias("cost"), "c_nationkey")).alias("choice"))


def f1_fifo_repair(spark, sf):
    x = _t(spark, sf, "lineitem").groupBy("l_suppkey", (F.col("l_orderkey") % 24 * 10).alias("t")).agg(F.max("l_quantity").cast("long").alias("v"))
    return R.fifo_repair(x, ["l_suppkey"], "t", "v").select("l_suppkey", "t", "v", "repaired", "changed")


def f3_longest_run(spark, sf):
    return R.longest_run(_t(spark, sf, "lineitem").select("l_suppkey", (F.col("l_orderkey") % 500).alias("p")), ["l_suppkey"], "p")


def f4_sessions(spark, sf):
    x = _t(spark, sf, "events")
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    y = x.withColumn("gap", F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag(F.col("ts").cast("timestamp")).over(w)))
    z = R.sessions(y, ["user_id"], ["ts", "event_id"], F.col("gap") > 3600 * 1_000_000)
    return z.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def f6_best_two(spark, sf):
    x = _t(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return R.best_two(x, ["l_suppkey"], "q", "l_linenumber", 10)


def f8_rank_quarters(spark, sf):
    return R.rank_quarters(_t(spark, sf, "customer"), ["c_nationkey"], ["c_acctbal", "c_custkey"]).select("c_custkey", "quarter")


def f10_average_rank(spark, sf):
    x = _t(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    return R.average_rank(x, ["p_brand"], "p_size").select("p_partkey", "avg_rank")


def f11_runs(spark, sf):
    x = _t(spark, sf, "lineitem").groupBy("l_suppkey", (F.col("l_orderkey") % 48).alias("bin")).agg((F.count("*") % 3).alias("score"))
    return I.islands(x, ["l_suppkey"], "bin", "score").select("l_suppkey", "score", "first", "last", "n")


def g1_top_k(spark, sf):
    x = _t(spark, sf, "customer")
    return R.top_k(x, ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "rank")


def h1_multiset_difference(spark, sf):
    x = _t(spark, sf, "lineitem")
    a = x.where("l_returnflag = 'A'").select("l_suppkey", "l_linenumber")
    b = x.where("l_returnflag = 'R'").select("l_suppkey", "l_linenumber")
    return R.multiset_difference(a, b).groupBy("side", "l_suppkey").agg(F.count("*").alias("n"))


def h2_overlap(spark, sf):
    x = _t(spark, sf, "lineitem")
    return x.where("l_returnflag = 'A'").select("l_partkey").intersect(x.where("l_returnflag = 'R'").select("l_partkey"))


def h5_first_seen(spark, sf):
    x = _t(spark, sf, "events")
    return R.first_seen(x, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def d14_semi(spark, sf):
    o = _t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return _t(spark, sf, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_nationkey")


def d15_unmatched(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, sf, "customer").join(o, "c_custkey", "left_anti").groupBy("c_nationkey").agg(F.count("*").alias("n"))


def d8_bins_to_links(spark, sf):
    l = _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    m = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("arc"))
    return l.join(m, "l_suppkey").groupBy("arc").agg(F.sum("n").alias("observations"), F.count("*").alias("links"))


def d17_matrix(spark, sf):
    r = _t(spark, sf, "region").select("r_name")
    s = _t(spark, sf, "customer").select("c_mktsegment").distinct()
    return r.crossJoin(s)  # five axes values each: a study matrix is the product of its axes


def d12_allocation(spark, sf):
    from pyspark.sql.window import Window

    x = _t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).alias("len"))
    return x.withColumn("fraction", F.round(F.col("len") / F.sum("len").over(Window.partitionBy("l_orderkey")), 6)).select("l_orderkey", "l_linenumber", "fraction")


_PCT = "quantile_cont({v}, {p})"
_A, _R, _N = _iv_sql("ia", "A"), _iv_sql("ir", "R"), _iv_sql("inn", "N")
_PAIR = "SELECT l_suppkey % 3 AS g, l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) - sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS d FROM lineitem GROUP BY l_suppkey"

SQL = {
    "c1_union": f"WITH {_A}, {_merge_sql('ia', 'ma')} SELECT k, s, e, s_inc, e_inc FROM ma",
    "c2_intersection": f"""WITH {_A}, {_merge_sql('ia', 'ma')}, {_R}, {_merge_sql('ir', 'mr')},
x AS (SELECT a.k, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e, CASE WHEN a.s = b.s THEN a.s_inc AND b.s_inc WHEN a.s > b.s THEN a.s_inc ELSE b.s_inc END AS s_inc, CASE WHEN a.e = b.e THEN a.e_inc AND b.e_inc WHEN a.e < b.e THEN a.e_inc ELSE b.e_inc END AS e_inc FROM ma a JOIN mr b ON a.k = b.k AND a.s <= b.e AND b.s <= a.e)
SELECT * FROM x WHERE s < e OR (s = e AND s_inc AND e_inc)""",
    # Difference by the complement: the gaps of R on the line, intersected with A.
    "c3_difference": f"""WITH {_A}, {_merge_sql('ia', 'ma')}, {_R}, {_merge_sql('ir', 'mr')},
g AS (SELECT k, e AS s, NOT e_inc AS s_inc, coalesce(lead(s) OVER w, 1000000) AS e, NOT coalesce(lead(s_inc) OVER w, false) AS e_inc FROM mr WINDOW w AS (PARTITION BY k ORDER BY s, e)
  UNION ALL SELECT k, -1000000, true, min(s), NOT bool_or(s_inc) FILTER (WHERE s = lo) FROM (SELECT *, min(s) OVER (PARTITION BY k) AS lo FROM mr) GROUP BY k
  UNION ALL SELECT DISTINCT k, -1000000, true, 1000000, true FROM ma WHERE k NOT IN (SELECT k FROM mr)),
x AS (SELECT a.k, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e, CASE WHEN a.s = b.s THEN a.s_inc AND b.s_inc WHEN a.s > b.s THEN a.s_inc ELSE b.s_inc END AS s_inc, CASE WHEN a.e = b.e THEN a.e_inc AND b.e_inc WHEN a.e < b.e THEN a.e_inc ELSE b.e_inc END AS e_inc FROM ma a JOIN g b ON a.k = b.k AND a.s <= b.e AND b.s <= a.e)
SELECT * FROM x WHERE s < e OR (s = e AND s_inc AND e_inc)""",
    "c4_split": f"""WITH {_A}, {_merge_sql('ia', 'ma')}, cuts AS (SELECT DISTINCT p_partkey % 40 AS k, p_partkey * 7 % 4000 AS cut FROM part),
m AS (SELECT k, s, e, s_inc, e_inc, s AS pos, s_inc AS ai FROM ma UNION ALL SELECT a.k, s, e, s_inc, e_inc, cut, true FROM ma a JOIN cuts c ON a.k = c.k AND s < cut AND cut < e)
SELECT k, pos AS s, coalesce(lead(pos) OVER w, e) AS e, ai AS s_inc, CASE WHEN lead(pos) OVER w IS NULL THEN e_inc ELSE false END AS e_inc FROM m WINDOW w AS (PARTITION BY k, s, e ORDER BY pos)""",
    "c5_integer_points": f"WITH {_N}, {_merge_sql('inn', 'mn')}, p AS (SELECT k, unnest(range(s + CASE WHEN s_inc THEN 0 ELSE 1 END, e + CASE WHEN e_inc THEN 1 ELSE 0 END)) AS t FROM mn) SELECT k, count(*) AS n, CAST(sum(t) AS bigint) AS total FROM p GROUP BY k",
    "c5_contains": f"WITH {_R}, {_merge_sql('ir', 'mr')} SELECT p.k, p.t FROM (SELECT p_partkey % 40 AS k, p_partkey % 4000 AS t FROM part) p WHERE EXISTS (SELECT 1 FROM mr WHERE mr.k = p.k AND ((mr.s < p.t AND p.t < mr.e) OR (p.t = mr.s AND s_inc) OR (p.t = mr.e AND e_inc)))",
    "e8_nearest_rank": "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.25) AS p25, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1",
    "e9_interpolated": "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1",
    "e10_iqr": "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr FROM orders GROUP BY 1",
    "e11_two_level_median": "SELECT o_orderpriority, round(median(m), 4) AS median, count(*) AS n_inner FROM (SELECT o_orderpriority, o_custkey, median(o_totalprice) AS m FROM orders GROUP BY 1, 2) GROUP BY 1",
    "e12_summary": "SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN value < 20 THEN 1 ELSE 0 END) AS bigint) AS n_ok, round(avg(CASE WHEN value < 20 THEN 1.0 ELSE 0.0 END), 6) AS ok_rate, round(avg(CASE WHEN value < 20 THEN value ELSE 40.0 END), 6) AS par2, round(1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS ci_half FROM events GROUP BY 1",
    "e12_histogram": "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS share FROM orders GROUP BY 1, 2",
    "e6_weighted_percentile": "WITH x AS (SELECT l_returnflag, l_extendedprice AS v, sum(CAST(l_quantity AS bigint)) AS w FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS c, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM x) SELECT l_returnflag, min(v) AS weighted_percentile FROM c WHERE c >= 0.5 * t GROUP BY 1",
    "e15_signed_rank": f"WITH d AS ({_PAIR}), z AS (SELECT *, abs(d) AS a FROM d WHERE d <> 0), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2.0 AS k FROM z), s AS (SELECT g, count(*) AS n, CAST(sum(CASE WHEN d > 0 THEN k ELSE 0 END) AS double) AS w_plus, CAST(sum(CASE WHEN d < 0 THEN k ELSE 0 END) AS double) AS w_minus FROM r GROUP BY g) SELECT g, n, w_plus, w_minus, round((w_plus - w_minus) / (w_plus + w_minus), 6) AS effect FROM s",
    "e15_signed_rank_p": f"WITH d AS ({_PAIR}), z AS (SELECT *, abs(d) AS a FROM d WHERE d <> 0), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2.0 AS k FROM z), s AS (SELECT g, count(*) AS n, CAST(sum(CASE WHEN d > 0 THEN k ELSE 0 END) AS double) AS wp, CAST(sum(CASE WHEN d < 0 THEN k ELSE 0 END) AS double) AS wm FROM r GROUP BY g), x AS (SELECT *, abs((least(wp, wm) - n * (n + 1) / 4.0::double + 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::double)) / sqrt(2.0::double) AS x FROM s) SELECT g, n, round((wp - wm) / (wp + wm), 6) AS effect, round(1 - (SELECT sum(pow(-1, j) * pow(x.x, 2 * j + 1) / (gamma(j + 1.0) * (2 * j + 1))) FROM range(0, 80) r(j)) * 2 / sqrt(pi()), 6) AS p FROM x UNION ALL SELECT 9, 0, 0.0, -1.0",
    "e16_holm": "WITH x AS (SELECT s_suppkey % 4 AS g, s_suppkey, (s_suppkey * 7919 % 1000) / 20000.0::double AS p FROM supplier), y AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY g) - row_number() OVER (PARTITION BY g ORDER BY p, s_suppkey) + 1) * p) AS st FROM x) SELECT g, s_suppkey, round(max(st) OVER (PARTITION BY g ORDER BY p, s_suppkey ROWS UNBOUNDED PRECEDING), 6) AS holm FROM y",
    "e17_speedup": "WITH x AS (SELECT l_suppkey, l_linenumber, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) SELECT x.l_suppkey, x.l_linenumber, round(b.v / x.v, 6) AS speedup, round(b.v / x.v / x.l_linenumber, 6) AS efficiency FROM x JOIN x b ON x.l_suppkey = b.l_suppkey AND b.l_linenumber = 1",
    "e20_kaplan_meier": "WITH t AS (SELECT l_returnflag, CAST(l_quantity AS bigint) AS t, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS d, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY t DESC) AS r FROM t), s AS (SELECT *, sum(CASE WHEN d = r THEN -1e9 ELSE ln(greatest(1 - d / r, 1e-300)) END) OVER (PARTITION BY l_returnflag ORDER BY t) AS s FROM r) SELECT l_returnflag, min(CASE WHEN s <= ln(0.5) + 1e-12 THEN t END) AS km_median FROM s GROUP BY 1",
    "e22_time_bins": "SELECT event_type, strftime(time_bucket(INTERVAL '60 minutes', ts), '%Y-%m-%d %H:%M') AS bin_start, round(median(value), 6) AS median_value, count(*) AS n, count(value) AS n_valid FROM events GROUP BY 1, 2",
    "e23_diagnostic": "SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing, min(value) AS least, max(value) AS most FROM events",
    "e24_impute": "WITH x AS (SELECT *, CASE WHEN c_nationkey = 7 OR c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer), a AS (SELECT c_nationkey, c_mktsegment, median(v) AS m FROM x WHERE v IS NOT NULL GROUP BY 1, 2), b AS (SELECT c_mktsegment, median(v) AS m FROM x WHERE v IS NOT NULL GROUP BY 1) SELECT c_custkey, CASE WHEN v IS NOT NULL THEN 'direct' WHEN a.m IS NOT NULL THEN 'level1' WHEN b.m IS NOT NULL THEN 'level2' ELSE 'default' END AS source, round(coalesce(v, a.m, b.m, 0.0), 4) AS filled FROM x LEFT JOIN a ON x.c_nationkey = a.c_nationkey AND x.c_mktsegment = a.c_mktsegment LEFT JOIN b ON x.c_mktsegment = b.c_mktsegment",
    "e25_capped_distinct": "SELECT l_suppkey, least(15, count(DISTINCT p_brand)) AS n_distinct FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "e19_resolve": "WITH x AS (SELECT c_mktsegment, c_nationkey, avg(c_acctbal) AS m, count(*) AS n FROM customer GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE WHEN m >= 4500 THEN 0 ELSE 1 END, CASE WHEN m >= 4500 THEN CAST(n AS double) ELSE -m END, c_nationkey) AS k FROM x) SELECT c_mktsegment, c_nationkey AS choice FROM r WHERE k = 1",
    "f1_fifo_repair": "WITH x AS (SELECT l_suppkey, l_orderkey % 24 * 10 AS t, CAST(max(l_quantity) AS bigint) AS v FROM lineitem GROUP BY 1, 2), y AS (SELECT *, max(t + v) OVER (PARTITION BY l_suppkey ORDER BY t ROWS UNBOUNDED PRECEDING) AS a FROM x) SELECT l_suppkey, t, v, a - t AS repaired, a > t + v AS changed FROM y",
    "f3_longest_run": "WITH x AS (SELECT DISTINCT l_suppkey, l_orderkey % 500 AS p FROM lineitem), y AS (SELECT *, p - row_number() OVER (PARTITION BY l_suppkey ORDER BY p) AS g FROM x), z AS (SELECT l_suppkey, min(p) AS first, count(*) AS length FROM y GROUP BY l_suppkey, g), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY length DESC, first) AS k FROM z) SELECT l_suppkey, first, length FROM r WHERE k = 1",
    "f4_sessions": "WITH x AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), y AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL '1 hour' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM x) SELECT user_id, CAST(session AS bigint) AS session, count(*) AS n, min(event_id) AS first_event FROM y GROUP BY user_id, session",
    "f6_best_two": "WITH x AS (SELECT l_suppkey, l_linenumber, CAST(sum(CAST(l_quantity AS bigint)) AS bigint) AS q FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_linenumber) AS k FROM x), b AS (SELECT l_suppkey, max(CASE WHEN k = 1 THEN l_linenumber END) AS best, max(CASE WHEN k = 1 THEN q END) AS best_score, max(CASE WHEN k = 2 THEN q END) AS second_score FROM r WHERE k <= 2 GROUP BY 1) SELECT *, coalesce(best_score - second_score < 10, false) AS ambiguous FROM b",
    "f8_rank_quarters": "SELECT c_custkey, CAST(floor(4.0 * (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1) / count(*) OVER (PARTITION BY c_nationkey)) AS bigint) AS quarter FROM customer",
    "f10_average_rank": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::double AS avg_rank FROM part",
    "f11_runs": "WITH x AS (SELECT l_suppkey, l_orderkey % 48 AS bin, count(*) % 3 AS score FROM lineitem GROUP BY 1, 2), y AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY bin) - row_number() OVER (PARTITION BY l_suppkey, score ORDER BY bin) AS g FROM x) SELECT l_suppkey, score, min(bin) AS first, max(bin) AS last, count(*) AS n FROM y GROUP BY l_suppkey, score, g",
    "g1_top_k": "WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) SELECT * FROM r WHERE rank <= 3",
    "h1_multiset_difference": "WITH a AS (SELECT l_suppkey, l_linenumber, sum(CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN -1 ELSE 0 END) AS d FROM lineitem GROUP BY 1, 2) SELECT CASE WHEN d > 0 THEN 'left' ELSE 'right' END AS side, l_suppkey, CAST(sum(abs(d)) AS bigint) AS n FROM a WHERE d <> 0 GROUP BY 1, 2",
    "h2_overlap": "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'",
    "h5_first_seen": "WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) SELECT user_id, event_type, event_id FROM r WHERE k = 1",
    "d14_semi": "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "d15_unmatched": "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1",
    "d8_bins_to_links": "WITH l AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT s_nationkey AS arc, CAST(sum(n) AS bigint) AS observations, count(*) AS links FROM l JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1",
    "d17_matrix": "SELECT r_name, c_mktsegment FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer)",
    "d12_allocation": "WITH x AS (SELECT l_orderkey, l_linenumber, sum(CAST(l_quantity AS bigint)) AS len FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, round(len / sum(len) OVER (PARTITION BY l_orderkey), 6) AS fraction FROM x",
}

QUERIES = {n: f for n, f in list(globals().items()) if n[0] in "cdefgh" and n[1:2].isdigit() and callable(f)}
