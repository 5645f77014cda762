"""Intervals of very different lengths and percentiles of large groups against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopath.operators import intervals as I
from chronopath.operators import records as R
from chronopath.operators import studies as ST
from chronopath.operators import workload as W

IV = "k int, s double, e double, s_inc boolean, e_inc boolean"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for side in range(2):
        some = [(int(rng.integers(0, 2)), float(s), float(s + n), bool(rng.integers(2)), bool(rng.integers(2))) for s, n in zip(rng.integers(-40, 60, 60), rng.choice([0, 1, 2, 8, 64, 3e10], 60), strict=True)]
        out.append([*some, (0, -1e12, 1e12, True, False), (0, 1e9, 1e9 + 1e-7, True, True), (1, 0.0, 0.0, True, True), (0, 0.0, 1e-300, True, True)])
    return out


def test_long_and_short_intervals_meet(spark, rows):
    want = []
    for k, s, e, si, ei in rows[0]:
        for k2, s2, e2, si2, ei2 in rows[1]:
            if k == k2 and (s < e or si and ei) and (s2 < e2 or si2 and ei2):
                lo, hi = max(s, s2), min(e, e2)
                lo_in, hi_in = (si or lo > s) and (si2 or lo > s2), (ei or hi < e) and (ei2 or hi < e2)
                if lo < hi or lo == hi and lo_in and hi_in:
                    want.append((k, lo, hi, lo_in, hi_in))
    alive = lambda x: [r for r in x if r[1] < r[2] or r[3] and r[4]]
    a, b = (spark.createDataFrame(alive(x), IV) for x in rows)
    got = sorted(tuple(r) for r in I.intersect(a, b, ["k"]).collect())
    assert got == sorted(want)


def test_one_long_interval_does_not_gather_short_ones(spark):
    short = spark.range(4000).selectExpr("0 as k", "cast(id as double) as s", "cast(id + 1 as double) as e", "true as s_inc", "false as e_inc")
    a = short.unionByName(spark.createDataFrame([(0, 0.0, 3e10, True, False)], IV))
    dealt = I._sized(a)
    assert dealt.groupBy("k", "_c", "_q").count().agg({"count": "max"}).first()[0] <= 9


def test_points_and_cuts(spark, rows):
    df = spark.createDataFrame(rows[0], IV)
    points = [(k, t) for k in (0, 1) for t in (-1e12, -3.0, 0.0, 0.5, 7.0, 1e9, 1e12, 5e300)]
    got = {tuple(r) for r in I.contains(df, spark.createDataFrame(points, "k int, t double"), ["k"]).collect()}
    assert got == {(k, t) for k, t in points if any(k == k2 and (s < t < e or t == s and si or t == e and ei) for k2, s, e, si, ei in rows[0])}
    whole = sorted({r for r in rows[0] if r[1] < r[2]})
    cells = I.split(spark.createDataFrame(whole, IV), spark.createDataFrame(points, "k int, cut double"), ["k"]).collect()
    want = []
    for k, s, e, si, ei in whole:
        at = [s, *sorted({t for k2, t in points if k2 == k and s < t < e}), e]
        want += [(k, x, y, si if i == 0 else True, ei if i == len(at) - 2 else False) for i, (x, y) in enumerate(zip(at, at[1:], strict=False))]
    assert sorted(tuple(r) for r in cells) == sorted(want)


def test_percentiles_of_groups_with_ties_and_nulls(spark):
    rng = np.random.default_rng(6)
    rows = [(None if g == 2 else int(g), None if x == 0 else float(x)) for g, x in zip(rng.integers(0, 3, 400), rng.integers(0, 30, 400), strict=True)] + [(7, 5.0), (8, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r.g: (r.least, r.low, r.high, r.mid, r.q3) for r in R.percentiles(df, ["g"], "x", {"least": 0.0, "low": 0.25, "high": 0.95}, {"mid": 0.5, "q3": 0.75}).collect()}
    want = {}
    for g in (0, 1, None, 7):
        v = sorted(x for k, x in rows if k == g and x is not None)
        rank = lambda p, v=v: v[max(int(np.ceil(len(v) * p)) - 1, 0)]
        want[g] = (rank(0.0), rank(0.25), rank(0.95), float(np.percentile(v, 50)), float(np.percentile(v, 75)))
    assert got == want
    assert R.percentiles(df.limit(0), ["g"], "x", {"low": 0.25}).count() == 0
    both = {r.g: (r.median, r.n_inner) for r in R.two_level_median(df.withColumn("t", df.x % 4), ["g"], "t", "x").collect()}
    assert both[7] == (5.0, 1) and both[8] == (None, 1)


def test_candidates_of_many_sources_in_one_cell(spark):
    """200,000 sources and destinations in one cell: pairs are never listed."""
    n = 200_000
    dst = spark.range(n).selectExpr("id as dst", "1 as cell", "id % 10 = 0 as bad").unionByName(spark.createDataFrame([(n, 2, False), (n + 1, 3, True), (n + 2, 4, False), (n + 3, 4, False), (n + 4, 4, True)], "dst long, cell int, bad boolean"))
    src = dst.select("dst", "cell").toDF("src", "cell").unionByName(spark.createDataFrame([(-1, 2), (-2, 9)], "src long, cell int"))
    reject = F.when(F.col("bad"), "bad")
    x = W.candidate_pairs(src, dst, 5, 3, reject).cache()
    ok = "size(accepted) = 3 and size(array_distinct(accepted)) = 3 and not array_contains(accepted, src) and forall(accepted, d -> d % 10 > 0 and d < 200000) and seen = 200000 and same = 1"
    assert x.where("cell = 1").where(ok).where("reasons['bad'] = 20000 - if(src % 10 = 0, 1, 0)").count() == n
    used = x.where("cell = 1").select(F.explode("accepted").alias("d")).groupBy("d").count()
    assert used.count() > 0.9 * n * 0.9 and used.agg({"count": "max"}).first()[0] < 30  # draws spread over all
    small = {r.src: (sorted(r.accepted), r.same, r.reasons, r.seen) for r in x.where("cell > 1").collect()}
    a, b = n + 2, n + 3
    assert small == {n: ([], 1, {}, 1), -1: ([n], 0, {}, 1), n + 1: ([], 1, {}, 1), a: ([b], 1, {"bad": 1}, 3), b: ([a], 1, {"bad": 1}, 3), n + 4: ([a, b], 1, {}, 3)}
    x.unpersist()


def test_bootstrap_holds_rows_once(spark, monkeypatch):
    """Against draws listed row by row; nothing as long as rows times draws is written down."""
    rng = np.random.default_rng(9)
    rows = [(None if g == 2 else int(g), None if x == 0 else float(x), i) for i, (g, x) in enumerate(zip(rng.integers(0, 3, 2000), rng.integers(0, 300, 2000), strict=True))] + [(7, 5.0, 9999), (8, None, 10000), (9, 1.0, 10001), (9, 2.0, 10002)]
    df = spark.createDataFrame(rows, "g int, x double, i long")
    written, checkpoint = [], R.checkpoint
    monkeypatch.setattr(R, "checkpoint", lambda x: written.append(checkpoint(x)) or written[-1])
    got = {r.g: (r.lo, r.hi) for r in R.bootstrap_median(df, ["g"], "x", "i", 40, block=16).collect()}
    assert max(x.count() for x in written) <= len(rows)
    chance = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    u = "(shiftrightunsigned(xxhash64(i, d, 7), 11) + 0.5D) / 9007199254740992D"
    every, want = df.where("x is not null").selectExpr("*", "explode(sequence(0, 39)) as d").selectExpr("g", "d", "x", f"{u} as u").toPandas(), {}
    every["n"] = (every.u.to_numpy()[:, None] > chance[None]).sum(1)
    for g, of in every.groupby("g", dropna=False):
        med = []
        for _, x in of.groupby("d"):
            x = x.sort_values("x")
            if x.n.sum():
                med.append(float(x.x[x.n.cumsum() >= x.n.sum() / 2].iloc[0]))
        rank = lambda p, v=sorted(med): v[math.ceil(len(v) * p) - 1]
        want[None if g != g else int(g)] = rank(0.025), rank(0.975)
    assert got == want


def test_quartiles_of_a_group_are_not_gathered_in_one_buffer(spark):
    """Levels with ties, nulls and no values; no plan has an aggregate that holds a group's values."""
    rng = np.random.default_rng(10)
    rows = [(None if g == 2 else int(g), None if x == 0 else float(x)) for g, x in zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500), strict=True)] + [(8, None)]
    df = spark.createDataFrame(rows, "g int, x double").withColumn("s", F.lit("COMPLETED")).withColumn("at", F.lit("2024-01-01 00:01:00").cast("timestamp"))
    want = {g: np.percentile([x for k, x in rows if k == g and x is not None] or [np.nan], [25, 50, 75, 50]).tolist() for g in (0, 1, None, 8)}
    level = ST.by_level(df, "g", F.col("x") > 3, F.col("x") > 30, "x", "x", "x", "x", "x")
    found = [level.select("g", "q1", "median", "q3"), ST.observations(df, ["g"], "x", "s", "x").select("g", "median_runtime"), ST.matched_medians(df, ["g"], ["x"]).select("g", "median_x"), R.time_bins(df, ["g"], "at", "x").select("g", "median_value"), R.impute(df.where("g is not null"), "x", [["g"]], F.lit(-1.0)).where("source = 'level1'").groupBy("g").agg(F.max("filled"))]
    for x in found:
        assert "percentile" not in x._jdf.queryExecution().optimizedPlan().toString() and "median(" not in x._jdf.queryExecution().optimizedPlan().toString()
        rows = x.collect()
        assert {r[0] for r in rows} in ({0, 1, None, 8}, {0, 1})
        for r in rows:
            assert [math.nan if v is None else v for v in r[1:]] == pytest.approx((want[r[0]] if len(r) == 4 else want[r[0]][1:2])[: len(r) - 1], nan_ok=True)
