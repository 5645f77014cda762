"""Queries for pairing, merging, selection and stitching, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopath.functions import fields as X
from chronopath.functions import temporal as T
from chronopath.operators import stitch as ST
from chronopath.operators import studies as S
from chronopath.plans.graph_queries import _WALKS, _bounds, _text
from chronopath.plans.temporal_graph import graph, sql


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _runs(spark, sf):
    """Line items as runs: supplier and month number as the unit, line number as method, status and time."""
    x = _t(spark, sf, "lineitem")
    return x.groupBy("l_suppkey", (F.col("l_orderkey") % 12).alias("axis"), F.col("l_linenumber").alias("method")).agg(F.max("l_extendedprice").alias("time"), F.min("l_quantity").alias("score"), F.max("l_returnflag").alias("flag"), F.count("*").alias("memory"))


def d16_matched_pairs(spark, sf):
    x = S.matched_pairs(_runs(spark, sf), ["l_suppkey", "axis"], "method", 1, "time")
    return x.select("l_suppkey", "axis", "method", F.round("value", 4).alias("value"), F.round("reference", 4).alias("reference"), F.round("ratio", 6).alias("ratio"))


def d16_planned(spark, sf):
    """Customers as planned runs, orders as records."""
    x = S.planned(_t(spark, sf, "customer").select("c_custkey", "c_nationkey"), _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")), ["c_custkey"])
    return x.select("c_custkey", "recorded", F.coalesce("n", F.lit(0)).alias("n"))


def e18_matched_medians(spark, sf):
    x = S.matched_pairs(_runs(spark, sf), ["l_suppkey", "axis"], "method", 1, "time")
    y = S.matched_medians(x, ["method"], ["ratio", "value"])
    return y.select("method", "paired_units", F.round("median_ratio", 6).alias("median_ratio"), F.round("median_value", 4).alias("median_value"))


def e21_observations(spark, sf):
    x = _runs(spark, sf).withColumn("status", F.when(F.col("flag") == "A", "COMPLETED").when(F.col("flag") == "N", "NO_FEASIBLE_PATH").otherwise("TIMEOUT"))
    y = S.observations(x, ["method"], "time", "status", "memory")
    return y.select("method", "observations", "timed", F.round("median_runtime", 4).alias("median_runtime"), F.round("p95_runtime", 4).alias("p95_runtime"), F.round("completed", 6).alias("completed"), F.round("timed_out", 6).alias("timed_out"), F.round("out_of_memory", 6).alias("out_of_memory"), "peak_memory")


def _cases(spark, sf):
    x = _t(spark, sf, "lineitem")
    return x.select("l_suppkey", "l_orderkey", F.col("l_linenumber").alias("level"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("double").alias("score"), (F.col("l_quantity") * 0.9).cast("double").alias("base"), F.col("l_extendedprice").cast("double").alias("travel"), (F.col("l_extendedprice") * 0.8).cast("double").alias("least"))


def e26_by_level(spark, sf):
    x = S.by_level(_cases(spark, sf), "level", F.col("flag") != "R", F.col("flag") == "R", "score", "base", "travel", "least", "travel")
    return x.select("level", "n", "n_done", *[F.round(c, 5).alias(c) for c in ("timeout_rate", "score", "base_score", "travel", "base_travel", "q1", "median", "q3", "score_gain", "score_gain_percent", "travel_premium_percent")])


def e26_level_change(spark, sf):
    x = S.level_change(_cases(spark, sf), ["l_orderkey"], "level", 1, 2, F.col("flag") != "R", "score")
    return x.select("n", F.round("mean_change", 6).alias("mean_change"), F.round("monotone_share", 6).alias("monotone_share"))


def e27_progress(spark, sf):
    return S.progress(_t(spark, sf, "customer").select("c_custkey", "c_mktsegment"), _t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus"), ["c_custkey"], "c_mktsegment", "o_orderstatus")


def d18_merge_reused(spark, sf):
    x = _t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return S.merge_reused(x.where("o_orderkey % 3 = 0"), x.where("o_orderkey % 3 <> 0"), ["o_orderkey"])


def d20_flatten(spark, sf):
    x = _t(spark, sf, "orders").select(F.struct("o_orderkey", F.struct(F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("state")).alias("who")).alias("run"), F.col("o_totalprice").alias("price"))
    return S.flatten(x)


def d14_semi_matched(spark, sf):
    return S.semi_matched(_t(spark, sf, "part").select("p_partkey", "p_brand"), _t(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


def d15_unmatched_parts(spark, sf):
    """Parts that no large line asks for: some there are."""
    return S.unmatched(_t(spark, sf, "part").select("p_partkey", "p_brand"), _t(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


def d8_to_links(spark, sf):
    l = _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return S.to_links(l, _t(spark, sf, "supplier"), "s_suppkey", "s_nationkey", "n")


def d9_with_attributes(spark, sf):
    x = S.with_attributes(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey")), _t(spark, sf, "supplier").where("s_nationkey < 20").select("s_suppkey", "s_nationkey"), "s_suppkey")
    return x.select("l_orderkey", "l_linenumber", F.coalesce("s_nationkey", F.lit(-1)).alias("nation"))


def d12_allocated(spark, sf):
    x = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("len"))
    return S.allocation(x, ["l_orderkey"], "len").select("l_orderkey", "l_linenumber", F.round("fraction", 6).alias("fraction"))


def d17_study_matrix(spark, sf):
    return S.study_matrix([_t(spark, sf, "region").select("r_name"), _t(spark, sf, "customer").select("c_mktsegment"), _t(spark, sf, "orders").select("o_orderpriority")])


def e19_resolved(spark, sf):
    x = _t(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.avg("c_acctbal").alias("m"), F.count("*").alias("n"))
    return S.resolve(x, ["c_mktsegment"], "c_nationkey", F.col("m") >= 4500, F.col("n").cast("double"), F.col("m"))


def e23_source_diagnostic(spark, sf):
    x = S.source_diagnostic(_t(spark, sf, "events"), "value", ["user_id", "event_type"])
    return x.withColumn("missing", F.round("missing", 6))


def e3_score_support(spark, sf):
    g = graph(spark, sf)
    best = g.scores.groupBy("arc_id").agg(F.max("score").alias("best"))
    return S.score_support(g.edges.select("arc_id", F.floor((F.col("u") - 1) / 5).alias("cell")).join(best, "arc_id"), "cell", "best").withColumn("first_arc", F.coalesce("first_arc", F.lit(-1)))


def e3_not_nested(spark, sf):
    """Parts by line number as variants: what a level has and the next one lacks."""
    return S.not_nested(_t(spark, sf, "lineitem").select(F.col("l_linenumber").alias("level"), F.col("l_partkey").alias("arc_id")).distinct())


def h4_pivot_coverage(spark, sf):
    """Orders as paths over parts; the parts that their customer's nation buys most are the pivots."""
    l = _t(spark, sf, "lineitem").withColumn("g", F.col("l_suppkey") % 5)
    paths = l.groupBy("g", "l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("int"))).alias("path")).withColumn("covered", F.array(F.lit(0).cast("long")))
    top = l.groupBy("g", F.col("l_partkey").cast("int").alias("arc_id")).agg(F.count("*").alias("n"))
    from chronopath.operators.records import top_k

    pivots = top_k(top, ["g"], [F.col("n").desc(), F.col("arc_id")], 8).select("g", "arc_id", "rank")
    return S.pivot_coverage(paths, pivots, ["g"]).select("g", "l_orderkey", F.array_join(F.transform("covered", lambda x: x.cast("string")), "-").alias("covered"))


def g2_anchors(spark, sf):
    g = graph(spark, sf)
    x = S.anchors(g.edges, g.queries, _bounds(spark, sf), g.scores)
    return x.select("query_id", "arc_id", "slack", "detour", "enter_from", "enter_to", "potential", "coverage", "rank")


def f5_overlapped_bins(spark, sf):
    """Suppliers' lines of a day as trips over the order number."""
    x = _t(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", (F.col("l_orderkey") % 500).cast("double").alias("at"))
    return S.overlapped_bins(x, ["l_suppkey", "l_linenumber"], "at", "at", 30.0, 470.0, 40.0).groupBy("bin").agg(F.count("*").alias("trips"))


def f7_first_and_count(spark, sf):
    x = S.first_and_count(_t(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["user_id"])
    return x.select("user_id", "event_type", "event_id", F.col("number").cast("long").alias("number"))


def g7_disjoint_pairs(spark, sf):
    """Suppliers and customers' nations of large lines: pairs without a common end, in order of quantity."""
    l = _t(spark, sf, "lineitem").groupBy((F.col("l_linenumber") % 3).alias("band"), F.col("l_suppkey").alias("a"), (1000 + F.col("l_partkey") % 25).alias("b")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return S.disjoint_pairs(l, "band", "a", "b", [(-F.col("q")).alias("x"), F.col("a"), F.col("b")], 6).select("band", "a", "b", "q")


def d6_stitch(spark, sf):
    """Arc, anchor, arc stitched, read at departures of a grid: arrival and score within the budget."""
    g = graph(spark, sf)
    day = F.lit(420.0), F.lit(540.0)
    whole = T.restrict(F.col("knots"), F.lit(0.0), F.lit(2640.0))
    one = g.edges.where("u <> v").select(F.lit(0).alias("query_id"), F.array("arc_id").alias("path"), F.array("u", "v").alias("nodes"), "knots", "pieces", F.array().cast("array<int>").alias("pivots"))
    left = one.select("query_id", "path", "nodes", T.to_arrival(T.restrict(F.col("knots"), *day)).alias("arrival"), T.score_restrict(F.col("pieces"), *day).alias("pieces"), "pivots")
    right = one.select("query_id", "path", "nodes", T.to_arrival(whole).alias("arrival"), T.score_restrict(F.col("pieces"), F.lit(0.0), F.lit(2640.0)).alias("pieces"), "pivots")
    x = ST.stitch(left, g.edges, right, spark.createDataFrame([(0, 45.0)], "query_id int, b double"))
    x = x.withColumn("t", F.explode(F.sequence(F.lit(420), F.lit(540), F.lit(8)))).withColumn("t", F.col("t").cast("double")).where("s <= t and t <= e")
    return x.select(_text(), "t", F.round(T.value_at(F.col("arrival"), F.col("t")), 6).alias("arrival"), T.score_at(F.col("pieces"), F.col("t")).alias("score"))


_RUN = "r AS (SELECT l_suppkey, l_orderkey % 12 AS axis, l_linenumber AS method, max(l_extendedprice) AS time, max(l_returnflag) AS flag, count(*) AS memory FROM lineitem GROUP BY 1, 2, 3), p AS (SELECT r.l_suppkey, r.axis, r.method, r.time AS value, b.time AS reference, CASE WHEN b.time > 0 THEN r.time / b.time END AS ratio FROM r JOIN r b ON r.l_suppkey = b.l_suppkey AND r.axis = b.axis AND b.method = 1 WHERE r.method <> 1)"
_CASE = "c AS (SELECT l_suppkey, l_orderkey, l_linenumber AS level, l_returnflag AS flag, CAST(l_quantity AS double) AS score, CAST(l_quantity * 0.9 AS double) AS base, CAST(l_extendedprice AS double) AS travel, CAST(l_extendedprice * 0.8 AS double) AS least FROM lineitem)"
_PAIRED = "AVG(CASE WHEN flag <> 'R' THEN {} END)"
def f_known_attributes(spark, sf):
    """Segments with holes: one in five is missing in one way or another, one has blanks about it."""
    x = _t(spark, sf, "customer").select("c_custkey", F.expr("CASE c_custkey % 5 WHEN 0 THEN array('nan', ' None', 'NULL ', '', NULL)[c_custkey % 25 div 5] WHEN 1 THEN concat('  ', c_mktsegment, ' ') ELSE c_mktsegment END").alias("raw"))
    return x.select("c_custkey", X.known(F.col("raw")).alias("segment"))


def f_schedule_times(spark, sf):
    """Orders as trips of a service day, some after midnight, some malformed."""
    x = _t(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.expr("CASE WHEN o_orderkey % 17 = 0 THEN 'soon' WHEN o_orderkey % 19 = 0 THEN '8:75:00' ELSE concat(o_orderkey % 30, ':', lpad(o_orderkey % 60, 2, '0'), IF(o_orderkey % 3 = 0, '', ':30')) END").alias("text"))
    return x.select("o_orderkey", F.coalesce(F.unix_timestamp(X.schedule_time(F.col("o_orderdate"), F.col("text"))), F.lit(-1)).alias("at"))


def f_encoded_lines(spark, sf):
    """Lines of customers' places, encoded and decoded: their points to five decimals."""
    x = _t(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 20).alias("line"), "c_custkey", ((F.col("c_custkey") * 6007 % 360000) / 1000.0 - 180).alias("x"), ((F.col("c_custkey") * 3001 % 180000) / 1000.0 - 90).alias("y"))
    lines = x.groupBy("line").agg(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))  # twenty each
    back = lines.select("line", F.posexplode(X.decode_line(X.encode_line(F.col("points")))).alias("i", "p"))
    return back.select("line", F.col("i").cast("long").alias("i"), F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


def f_event_properties(spark, sf):
    """Properties of events as maps, counted by key."""
    x = _t(spark, sf, "events").select("event_type", F.explode(F.from_json("props", "map<string, bigint>")).alias("key", "value"))
    return x.groupBy("event_type", "key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def g6_stable_order(spark, sf):
    """Lines of an order as candidates: those that agree in the first keys are told apart by the later ones."""
    x = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") % 2).alias("s"), F.array((F.col("l_partkey") % 2).cast("int")).alias("path"), (F.col("l_discount") * 100 % 3).cast("int").alias("e"), F.array((F.col("l_tax") * 100 % 2).cast("int")).alias("arrival"), F.array((F.col("l_suppkey") % 3).cast("int")).alias("pieces"), F.sequence(F.col("l_linenumber"), F.lit(8)).alias("pivots"))
    return S.stable_order(x, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "place")


SQL = {
    "f_known_attributes": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'UNKNOWN' ELSE c_mktsegment END AS segment FROM customer",
    "f_schedule_times": "SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 THEN CAST(epoch(date_trunc('day', o_orderdate)) AS bigint) + o_orderkey % 30 * 3600 + o_orderkey % 60 * 60 + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 30 END ELSE -1 END AS at FROM orders",
    "f_encoded_lines": "SELECT c_custkey // 20 AS line, row_number() OVER (PARTITION BY c_custkey // 20 ORDER BY c_custkey) - 1 AS i, round(c_custkey * 6007 % 360000 / 1000.0 - 180, 5) AS x, round(c_custkey * 3001 % 180000 / 1000.0 - 90, 5) AS y FROM customer",
    "f_event_properties": "SELECT event_type, u.k AS key, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.' || u.k) AS bigint)) AS bigint) AS total FROM events, unnest(json_keys(props)) AS u(k) GROUP BY 1, 2",
    "g6_stable_order": "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity % 2, l_partkey % 2, CAST(trunc(l_discount * 100 % 3) AS int), CAST(trunc(l_tax * 100 % 2) AS int), l_suppkey % 3, l_linenumber DESC) AS place FROM lineitem",
    "d16_matched_pairs": f"WITH {_RUN} SELECT l_suppkey, axis, method, round(value, 4) AS value, round(reference, 4) AS reference, round(ratio, 6) AS ratio FROM p",
    "d16_planned": "SELECT c_custkey, count(o_orderkey) > 0 AS recorded, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "e18_matched_medians": f"WITH {_RUN} SELECT method, count(*) AS paired_units, round(median(ratio), 6) AS median_ratio, round(median(value), 4) AS median_value FROM p GROUP BY 1",
    "e21_observations": f"WITH {_RUN} SELECT method, count(*) AS observations, count(time) AS timed, round(median(time), 4) AS median_runtime, round(quantile_disc(time, 0.95), 4) AS p95_runtime, round(avg(CASE WHEN flag IN ('A', 'N') THEN 1.0 ELSE 0.0 END), 6) AS completed, round(avg(CASE WHEN flag IN ('A', 'N') THEN 0.0 ELSE 1.0 END), 6) AS timed_out, 0.0::double AS out_of_memory, max(memory) AS peak_memory FROM r GROUP BY 1",
    "e26_by_level": f"""WITH {_CASE}, x AS (SELECT level, count(*) AS n, count(CASE WHEN flag <> 'R' THEN 1 END) AS n_done, avg(CASE WHEN flag = 'R' THEN 1.0 ELSE 0.0 END) AS tr, {_PAIRED.format('score')} AS s, {_PAIRED.format('base')} AS bs, {_PAIRED.format('travel')} AS t, {_PAIRED.format('least')} AS bt, quantile_cont(travel, 0.25) AS q1, quantile_cont(travel, 0.5) AS median, quantile_cont(travel, 0.75) AS q3 FROM c GROUP BY 1)
SELECT level, n, n_done, round(tr, 5) AS timeout_rate, round(s, 5) AS score, round(bs, 5) AS base_score, round(t, 5) AS travel, round(bt, 5) AS base_travel, round(q1, 5) AS q1, round(median, 5) AS median, round(q3, 5) AS q3, round(s - bs, 5) AS score_gain, round(100 * (s - bs) / bs, 5) AS score_gain_percent, round(100 * (t - bt) / bt, 5) AS travel_premium_percent FROM x""",
    "e26_level_change": f"WITH {_CASE} SELECT count(*) AS n, round(avg(b.score - a.score), 6) AS mean_change, round(avg(CASE WHEN b.score >= a.score THEN 1.0 ELSE 0.0 END), 6) AS monotone_share FROM c a JOIN c b USING (l_orderkey) WHERE a.level = 1 AND b.level = 2 AND a.flag <> 'R' AND b.flag <> 'R'",
    "e27_progress": "SELECT c_mktsegment, count(*) AS planned, count(o_orderstatus) AS recorded, count(*) - count(o_orderkey) AS left_over, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS n_o, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS n_p FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "d18_merge_reused": "SELECT o_orderkey, o_custkey, CASE o_orderkey % 3 WHEN 0 THEN 'FRESH' ELSE 'REUSED' END AS origin FROM orders",
    "d20_flatten": "SELECT o_orderkey AS run_o_orderkey, o_custkey AS run_who_cust, o_orderstatus AS run_who_state, o_totalprice AS price FROM orders",
    "d14_semi_matched": "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "d15_unmatched_parts": "SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "d8_to_links": "SELECT s_nationkey, CAST(sum(n) AS bigint) AS observations, count(*) AS sources FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1",
    "d9_with_attributes": "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN s_nationkey < 20 THEN s_nationkey END, -1) AS nation FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey",
    "d12_allocated": "SELECT l_orderkey, l_linenumber, round(CAST(l_quantity AS bigint) / sum(CAST(l_quantity AS bigint)) OVER (PARTITION BY l_orderkey), 6) AS fraction FROM lineitem",
    "d17_study_matrix": "SELECT r_name, c_mktsegment, o_orderpriority FROM region, (SELECT DISTINCT c_mktsegment FROM customer), (SELECT DISTINCT o_orderpriority FROM orders)",
    "e19_resolved": "WITH x AS (SELECT c_mktsegment, c_nationkey, avg(c_acctbal) AS m, count(*) AS n FROM customer GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE WHEN m >= 4500 THEN 0 ELSE 1 END, CASE WHEN m >= 4500 THEN CAST(n AS double) ELSE -m END, c_nationkey) AS k FROM x) SELECT c_mktsegment, c_nationkey AS choice FROM r WHERE k = 1",
    "e23_source_diagnostic": "SELECT count(*) AS n, count(DISTINCT user_id) AS n_user_id, count(DISTINCT event_type) AS n_event_type, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing, min(value) AS least, max(value) AS most FROM events",
    "e3_score_support": sql(" SELECT cell, count(CASE WHEN best > 0 THEN 1 END) AS n_support, count(*) AS n_arcs, coalesce(min(CASE WHEN best > 0 THEN arc_id END), -1) AS first_arc FROM (SELECT CAST((u - 1) // 5 AS bigint) AS cell, arc_id, (SELECT max(score) FROM scores s WHERE s.arc_id = e.arc_id) AS best FROM edges e) GROUP BY 1"),
    "e3_not_nested": "WITH v AS (SELECT DISTINCT l_linenumber AS level, l_partkey AS arc_id FROM lineitem) SELECT a.level, a.level + 1 AS next, a.arc_id FROM v a LEFT JOIN v b ON b.level = a.level + 1 AND b.arc_id = a.arc_id WHERE b.level IS NULL AND a.level < (SELECT max(level) FROM v)",
    "h4_pivot_coverage": "WITH l AS (SELECT l_suppkey % 5 AS g, l_orderkey, l_partkey FROM lineitem), n AS (SELECT g, l_partkey, count(*) AS n FROM l GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, l_partkey) AS rank FROM n), h AS (SELECT DISTINCT l.g, l_orderkey, rank FROM l JOIN p ON p.g = l.g AND p.l_partkey = l.l_partkey AND rank <= 8 UNION SELECT DISTINCT g, l_orderkey, 0 FROM l) SELECT g, l_orderkey, string_agg(rank, '-' ORDER BY rank) AS covered FROM h GROUP BY 1, 2",
    "g2_anchors": sql(_WALKS + """, j AS (SELECT q.query_id, e.arc_id, q.b - a.from_src - l.lb - z.to_dst AS slack, a.from_src + l.lb + z.to_dst - d.to_dst AS detour, q.ts + a.from_src AS enter_from, q.te + q.b - l.lb - z.to_dst AS enter_to FROM qs q JOIN bnd a ON a.query_id = q.query_id JOIN edges e ON e.u = a.node JOIN lows l ON l.arc_id = e.arc_id JOIN bnd z ON z.query_id = q.query_id AND z.node = e.v JOIN bnd d ON d.query_id = q.query_id AND d.node = q.src WHERE e.u <> e.v),
x AS (SELECT query_id, arc_id, slack, detour, enter_from, enter_to, sum(greatest(least(t1, enter_to) - greatest(t0, enter_from), 0) * score) AS potential, sum(greatest(least(t1, enter_to) - greatest(t0, enter_from), 0)) AS coverage FROM j JOIN scores USING (arc_id) WHERE slack >= 0 AND enter_from <= enter_to AND score > 0 AND t0 <= enter_to AND t1 > enter_from GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY potential DESC, coverage DESC, slack DESC, detour, arc_id) AS rank FROM x""", True),
    "f5_overlapped_bins": "WITH s AS (SELECT l_suppkey, l_linenumber, greatest(min(l_orderkey % 500), 30) AS a, least(max(l_orderkey % 500), 470) AS z FROM lineitem GROUP BY 1, 2), b AS (SELECT unnest(range(greatest((a - 30) // 40, 0), least((z - 30) // 40, 10) + 1)) AS bin FROM s WHERE a <= z) SELECT CAST(bin AS int) AS bin, count(*) AS trips FROM b GROUP BY 1",
    "f7_first_and_count": "WITH r AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS number FROM r WHERE k = 1",
    # Greedy by recursion over the order: a pair is taken unless one of its ends was.
    "g7_disjoint_pairs": """WITH RECURSIVE l AS (SELECT l_linenumber % 3 AS band, l_suppkey AS a, 1000 + l_partkey % 25 AS b, CAST(sum(CAST(l_quantity AS bigint)) AS bigint) AS q FROM lineitem GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY q DESC, a, b) AS k FROM l),
g AS (SELECT band, 0::bigint AS k, []::bigint[] AS used, []::bigint[] AS won FROM (SELECT DISTINCT band FROM l)
  UNION ALL SELECT g.band, o.k, CASE WHEN list_contains(used, o.a) OR list_contains(used, o.b) THEN used ELSE list_concat(used, [o.a, o.b]) END, CASE WHEN list_contains(used, o.a) OR list_contains(used, o.b) THEN won ELSE list_append(won, o.k) END FROM g JOIN o ON o.band = g.band AND o.k = g.k + 1 WHERE len(won) < 6)
SELECT o.band, o.a, o.b, o.q FROM o JOIN (SELECT band, unnest(won) AS k FROM (SELECT band, arg_max(won, k) AS won FROM g GROUP BY band)) w ON w.band = o.band AND w.k = o.k""",
    "d6_stitch": sql(""", seg AS (SELECT a.arc_id, a.t AS t0, a.tau AS v0, b.t AS t1, b.tau AS v1 FROM knots a JOIN knots b ON b.arc_id = a.arc_id AND b.k = a.k + 1),
dep AS (SELECT CAST(unnest(range(420, 541, 8)) AS double) AS t),
w AS (SELECT x.arc_id AS x, y.arc_id AS y, z.arc_id AS z, t FROM edges x JOIN edges y ON y.u = x.v AND y.v <> x.u AND y.u <> y.v JOIN edges z ON z.u = y.v AND z.v NOT IN (x.u, x.v, y.v) CROSS JOIN dep WHERE x.u <> x.v),
p AS (SELECT w.*, t + v0 + (v1 - v0) * (t - t0) / 120 AS a1 FROM w JOIN seg ON arc_id = x AND t0 <= t AND t < t1),
q AS (SELECT p.*, a1 + v0 + (v1 - v0) * (a1 - t0) / 120 AS a2 FROM p JOIN seg ON arc_id = y AND t0 <= a1 AND a1 < t1),
r AS (SELECT q.*, a2 + v0 + (v1 - v0) * (a2 - t0) / 120 AS a3 FROM q JOIN seg ON arc_id = z AND t0 <= a2 AND a2 < t1)
SELECT x || '-' || y || '-' || z AS path, t, round(a3, 6) AS arrival, s1.score + s2.score + s3.score AS score FROM r JOIN scores s1 ON s1.arc_id = x AND s1.t0 <= t AND t < s1.t1 JOIN scores s2 ON s2.arc_id = y AND s2.t0 <= a1 AND a1 < s2.t1 JOIN scores s3 ON s3.arc_id = z AND s3.t0 <= a2 AND a2 < s3.t1 WHERE a3 - t <= 45"""),
}
QUERIES = {n: f for n, f in list(globals().items()) if n in SQL}
