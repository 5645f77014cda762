"""Queries over profiles that are derived from the star schema, whose every figure SQL can tell as well."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopath.operators import envelopes as E


def _profile(spark, sf, side, n, scale):
    """Winners over [0, 240) in ``n`` cells of each supplier: the path is a line number, none where four divides how
    many lines there are. ``side`` picks the parts by parity, of which one makes the candidate and the other the
    reference; without it all count."""
    x = spark.read.parquet(f"{sf}/lineitem.parquet").where("true" if side is None else f"l_partkey % 2 = {side}")
    x = x.groupBy((F.col("l_suppkey") % 50).alias("query_id"), (F.col("l_orderkey") % n).alias("i")).agg(F.when(F.count("*") % 4 != 0, F.max("l_linenumber")).alias("p"), (F.count("*") % 4).alias("score"), F.max("l_quantity").cast("double").alias("travel_lo"), F.min("l_quantity").cast("double").alias("travel_hi"))
    every = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_suppkey") % 50).alias("query_id")).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("i", F.col("i").cast("long"))
    y = every.join(x, ["query_id", "i"], "left")
    return y.select("query_id", (F.col("i") * scale).cast("double").alias("lo"), ((F.col("i") + 1) * scale).cast("double").alias("hi"), F.when(F.col("p").isNotNull(), F.array(F.col("p").cast("int"))).alias("path"), *[F.when(F.col("p").isNotNull(), F.col(c)).alias(c) for c in ("score", "travel_lo", "travel_hi")])


def _whole(spark, sf):
    return _profile(spark, sf, None, 24, 10)


def _candidate(spark, sf):
    return _profile(spark, sf, 0, 24, 10)


def _reference(spark, sf):
    return _profile(spark, sf, 1, 16, 15)


def _plain(df, *columns):
    """Nulls as -1, so that engines agree on how they print them."""
    return df.withColumns({c: F.coalesce(c, F.lit(-1)) for c in columns})


def e4_profile_metrics(spark, sf):
    return _plain(E.metrics(_whole(spark, sf)), "avg_score", "avg_travel", "best_score")


def e5_quality(spark, sf):
    return _plain(E.quality(_candidate(spark, sf), _reference(spark, sf)), "mean_gap", "max_gap", "p95_gap", "tie_travel_gap")


def c15_merged_assignments(spark, sf):
    return E.merge_segments(_whole(spark, sf)).select("query_id", "s", "e", F.coalesce(F.get("path", F.lit(0)), F.lit(-1)).alias("path"))


def _candidates(spark, sf):
    """Line numbers as paths in each supplier's 24 cells."""
    x = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy((F.col("l_suppkey") % 50).alias("query_id"), (F.col("l_orderkey") % 24).alias("i"), F.col("l_linenumber").cast("int").alias("p"))
    x = x.agg((F.count("*") % 3).alias("score"), (F.max("l_partkey") % 6).cast("double").alias("travel_lo"), (F.min("l_partkey") % 6).cast("double").alias("travel_hi"))
    return x.select("query_id", (F.col("i") * 10).cast("double").alias("lo"), (F.col("i") * 10 + 10).cast("double").alias("hi"), F.array("p").alias("path"), (F.col("p") % 3 + 1).alias("n_edges"), "score", ((F.col("travel_lo") + F.col("travel_hi")) / 2).alias("travel"), "travel_lo", "travel_hi")


def _budgets(spark, sf):
    return _candidates(spark, sf).select("query_id").distinct().withColumn("b", F.lit(8.0))


def _kept(df, *columns):
    return df.select("query_id", "lo", "hi", F.get("path", F.lit(0)).alias("path"), *columns)


def c7_safe_dominance(spark, sf):
    return _kept(E.undominated(_candidates(spark, sf)), "score")


def c8_retained_roles(spark, sf):
    return _kept(E.retain(E.cell_integrals(_candidates(spark, sf), _budgets(spark, sf)), 3), "role")


def c9_cell_integrals(spark, sf):
    return _kept(E.cell_integrals(_candidates(spark, sf), _budgets(spark, sf)), "avg_travel", "min_slack", "coverage", "inner")


def c10_distinct_candidates(spark, sf):
    x = _candidates(spark, sf).withColumnRenamed("lo", "s").withColumnRenamed("hi", "e")
    return E.distinct_candidates(x.unionByName(x).drop("travel", "travel_lo", "travel_hi", "n_edges")).select("query_id", "s", "e", F.get("path", F.lit(0)).alias("path"), "score")


def c12_compressed(spark, sf):
    return E.compress(_candidates(spark, sf), _budgets(spark, sf), 2).select("query_id", F.get("path", F.lit(0)).alias("path"), "s", "e", "role")


def _sql(name, where, n, scale):
    return f"""{name}_x AS (SELECT l_suppkey % 50 AS q, l_orderkey % {n} AS i, CASE WHEN count(*) % 4 <> 0 THEN max(l_linenumber) END AS p, CASE WHEN count(*) % 4 <> 0 THEN count(*) % 4 END AS score, CASE WHEN count(*) % 4 <> 0 THEN CAST(max(l_quantity) AS double) END AS v0, CASE WHEN count(*) % 4 <> 0 THEN CAST(min(l_quantity) AS double) END AS v1 FROM lineitem WHERE {where} GROUP BY 1, 2),
{name} AS (SELECT q, CAST(i * {scale} AS double) AS lo, CAST((i + 1) * {scale} AS double) AS hi, p, score, v0, v1 FROM (SELECT q, i FROM (SELECT DISTINCT l_suppkey % 50 AS q FROM lineitem) CROSS JOIN (SELECT unnest(range({n})) AS i)) LEFT JOIN {name}_x USING (q, i)),
{name}_n AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(p) OVER w IS DISTINCT FROM p THEN 1 ELSE 0 END AS new FROM {name} WINDOW w AS (PARTITION BY q ORDER BY lo)),
{name}_r AS (SELECT *, sum(new) OVER (PARTITION BY q ORDER BY lo) AS run FROM {name}_n),
{name}_s AS (SELECT q, run, min(lo) AS s, max(hi) AS e, max(p) AS p FROM {name}_r GROUP BY q, run)"""


_A, _B, _W = _sql("a", "l_partkey % 2 = 0", 24, 10), _sql("b", "l_partkey % 2 = 1", 16, 15), _sql("a", "true", 24, 10)
_CAND = """c AS (SELECT l_suppkey % 50 AS q, CAST(l_orderkey % 24 * 10 AS double) AS lo, CAST(l_orderkey % 24 * 10 + 10 AS double) AS hi, l_linenumber AS p, l_linenumber % 3 + 1 AS ne, count(*) % 3 AS score, CAST(max(l_partkey) % 6 AS double) AS v0, CAST(min(l_partkey) % 6 AS double) AS v1 FROM lineitem GROUP BY ALL),
m AS (SELECT *, (v0 + v1) / 2 AS av, 8.0 - greatest(v0, v1) AS slack, sum(hi - lo) OVER (PARTITION BY q, p) AS cover, ne - 1 AS inn FROM {src})"""
_DOM = "u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, lo, v0, v1 ORDER BY score DESC, ne, p) AS r FROM c) WHERE r = 1)"
_ROLE = """o AS (SELECT *, row_number() OVER (w ORDER BY score DESC, av, ne, p) AS a, row_number() OVER (w ORDER BY av, score DESC, ne, p) AS b, row_number() OVER (w ORDER BY cover DESC, score DESC, av, ne, p) AS d, row_number() OVER (w ORDER BY inn, av, score DESC, ne, p) AS e, row_number() OVER (w ORDER BY score DESC, av, slack DESC, cover DESC, inn, ne, p) AS f FROM m WINDOW w AS (PARTITION BY q, lo, hi)),
k AS (SELECT *, CASE WHEN a = 1 THEN 0 WHEN b = 1 THEN 1 WHEN d = 1 THEN 2 WHEN e = 1 THEN 3 ELSE 4 END AS role FROM o), z AS (SELECT *, row_number() OVER (PARTITION BY q, lo, hi ORDER BY role, f) AS n FROM k)"""
SQL = {
    "c7_safe_dominance": f"WITH {_CAND.format(src='c')}, {_DOM} SELECT q AS query_id, lo, hi, p AS path, score FROM u",
    "c8_retained_roles": f"WITH {_CAND.format(src='c')}, {_ROLE} SELECT q AS query_id, lo, hi, p AS path, role FROM z WHERE n <= 3",
    "c9_cell_integrals": f"WITH {_CAND.format(src='c')} SELECT q AS query_id, lo, hi, p AS path, av AS avg_travel, slack AS min_slack, cover AS coverage, inn AS inner FROM m".replace("AS inner", 'AS "inner"'),
    "c10_distinct_candidates": f"WITH {_CAND.format(src='c')} SELECT q AS query_id, lo AS s, hi AS e, p AS path, score FROM c",
    "c12_compressed": f"""WITH {_CAND.format(src='u').replace("FROM lineitem GROUP BY ALL),", "FROM lineitem GROUP BY ALL), " + _DOM + ",")}, {_ROLE}, g AS (SELECT *, lo - 10 * row_number() OVER (PARTITION BY q, p ORDER BY lo) AS run FROM z WHERE n <= 2)
SELECT q AS query_id, p AS path, min(lo) AS s, max(hi) AS e, min(role) AS role FROM g GROUP BY q, p, run""",
    "c15_merged_assignments": f"WITH {_W} SELECT q AS query_id, s, e, coalesce(p, -1) AS path FROM a_s",
    "e4_profile_metrics": f"""WITH {_W}, o AS (SELECT q, sum(hi - lo) AS t, sum(CASE WHEN p IS NOT NULL THEN hi - lo ELSE 0 END) AS c, count(p) > 0 AS f, count(DISTINCT p) AS paths, sum(score * (hi - lo)) AS s, sum((v0 + v1) / 2 * (hi - lo)) AS v, max(score) AS best FROM a GROUP BY q), g AS (SELECT q, count(*) AS n, min(e - s) AS least FROM a_s GROUP BY q)
SELECT q AS query_id, f AS feasible, round(c, 6) AS covered, round(t - c, 6) AS uncovered, round(c / t, 6) AS coverage, n AS n_segments, paths AS n_paths, n - 1 AS n_changes, round(t / n, 6) AS avg_length, round(least, 6) AS min_length, coalesce(round(s / nullif(c, 0), 6), -1) AS avg_score, coalesce(round(v / nullif(c, 0), 6), -1) AS avg_travel, coalesce(best, -1) AS best_score FROM o JOIN g USING (q)""",
    "e5_quality": f"""WITH {_A}, {_B}, j AS (SELECT a.q, greatest(a.lo, b.lo) AS t, least(a.hi, b.hi) AS z, a.p AS pa, b.p AS pb, a.score AS sa, b.score AS sb, a.v0 + (a.v1 - a.v0) * (greatest(a.lo, b.lo) - a.lo) / 10 AS x0, a.v0 + (a.v1 - a.v0) * (least(a.hi, b.hi) - a.lo) / 10 AS x1, b.v0 + (b.v1 - b.v0) * (greatest(a.lo, b.lo) - b.lo) / 15 AS y0, b.v0 + (b.v1 - b.v0) * (least(a.hi, b.hi) - b.lo) / 15 AS y1 FROM a JOIN b ON a.q = b.q AND a.lo < b.hi AND b.lo < a.hi),
k AS (SELECT *, z - t AS w, coalesce(sa, 0) AS cs, pb IS NOT NULL AS ob, pb IS NOT NULL AND pa IS NOT NULL AND sa = sb AS tie, x0 - y0 AS d0, x1 - y1 AS d1 FROM j),
sm AS (SELECT q, sum(w) AS t, sum(CASE WHEN pa IS NOT DISTINCT FROM pb THEN w ELSE 0 END) AS ag, sum(CASE WHEN (pa IS NULL) <> (pb IS NULL) THEN w ELSE 0 END) AS fd, sum(CASE WHEN ob THEN w ELSE 0 END) AS o, sum(CASE WHEN tie THEN w ELSE 0 END) AS sc, sum(CASE WHEN ob THEN greatest(sb - cs, 0) * w ELSE 0 END) AS rn, sum(CASE WHEN ob THEN greatest(sb, 1) * w ELSE 0 END) AS rd, sum(CASE WHEN ob THEN abs(sb - cs) * w ELSE 0 END) AS ga, max(CASE WHEN ob THEN abs(sb - cs) END) AS mg, sum(CASE WHEN tie THEN CASE WHEN d0 * d1 >= 0 THEN (abs(d0) + abs(d1)) / 2 * w ELSE (d0 * d0 + d1 * d1) / (abs(d0) + abs(d1)) / 2 * w END ELSE 0 END) AS tg FROM k GROUP BY q),
g AS (SELECT q, gap, sum(w) OVER (PARTITION BY q ORDER BY gap) AS c, sum(w) OVER (PARTITION BY q) AS o FROM (SELECT q, abs(sb - cs) AS gap, sum(w) AS w FROM k WHERE ob GROUP BY 1, 2)), p AS (SELECT q, min(gap) AS p95 FROM g WHERE c >= 0.95 * o - 1e-9 GROUP BY q),
n AS (SELECT q, (SELECT count(*) FROM a_s x WHERE x.q = sm.q AND run > 1) AS na, (SELECT count(*) FROM b_s x WHERE x.q = sm.q AND run > 1) AS nb, (SELECT count(*) FROM a_s x JOIN b_s y ON x.q = y.q AND x.s = y.s AND x.run > 1 AND y.run > 1 WHERE x.q = sm.q) AS nc FROM sm)
SELECT q AS query_id, round(ag / t, 6) AS path_agreement, coalesce(round(sc / nullif(o, 0), 6), 1) AS score_agreement, round(fd / t, 6) AS feasibility_disagreement, coalesce(round(nc / nullif(na, 0), 6), 1) AS breakpoint_precision, coalesce(round(nc / nullif(nb, 0), 6), 1) AS breakpoint_recall, na = nc AND nb = nc AS same_breakpoints, coalesce(round(rn / nullif(rd, 0), 6), 0) AS score_regret, coalesce(round(100 * rn / nullif(rd, 0), 6), 0) AS score_gap_percent, coalesce(round(ga / nullif(o, 0), 6), -1) AS mean_gap, coalesce(mg, -1) AS max_gap, coalesce(p95, -1) AS p95_gap, coalesce(round(tg / nullif(sc, 0), 6), -1) AS tie_travel_gap, nb - nc AS missed_switches FROM sm LEFT JOIN p USING (q) JOIN n USING (q)""",
}
QUERIES = {n: f for n, f in list(globals().items()) if n in SQL}
