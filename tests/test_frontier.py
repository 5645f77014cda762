"""Bounded search, dominance, interval labels and growing frontiers against exhaustive ones on seeded graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_profiles import SCHEMA, all_paths, best, random_graph, walk

from chronopath.operators import algorithms as A
from chronopath.operators import envelopes as E
from chronopath.operators import frontier as FR
from chronopath.operators import incremental as I
from chronopath.operators import interval_labels as L
from chronopath.operators import paths as P
from chronopath.plans.temporal_graph import Graph

QUERY = "query_id int, src int, dst int, ts int, te int, b int"


def segments(df):
    return sorted((r.query_id, round(r.s, 6), round(r.e, 6), r.s_inc, r.e_inc, tuple(r.path) if r.path is not None else None) for r in df.collect())


def parallel(rng):
    """Twice the arcs, so that labels with the same arrival and different scores meet."""
    arcs = random_graph(rng)
    return arcs + [(7 + i, u, v, w, lb, k, [(a, b, int(rng.integers(0, 4))) for a, b, _ in p]) for i, u, v, w, lb, k, p in arcs[:4]]


def setup(spark, seed, make=parallel):
    rng = np.random.default_rng(seed)
    arcs = make(rng)
    edges = spark.createDataFrame(arcs, SCHEMA)
    queries = spark.createDataFrame([(0, 1, 4, 0, 8, int(rng.integers(5, 11))), (1, 2, 2, 0, 3, 5), (2, 1, 3, 4, 4, 9), (3, 4, 1, 0, 5, 9)], QUERY)
    bounds = P.both_bounds(edges, queries).persist()
    exact = P.profiles(edges, queries, bounds).persist()
    scores = edges.select("arc_id", F.posexplode("pieces").alias("k", "p")).select("arc_id", "k", "p.*")
    pivots = A.pivots(Graph(edges, None, scores, queries), queries, P.corridor(edges, queries, bounds), 4)
    return arcs, edges, queries, bounds, exact, pivots


@pytest.mark.parametrize("seed", [0, 2])
def test_without_caps_all_searches_are_exact(spark, seed):
    arcs, edges, queries, bounds, exact, pivots = setup(spark, seed)
    want = segments(E.envelope(exact, queries))
    free = FR.layered(edges, queries, pivots, bounds, FR.Bounded(2, 2, FR.NO_CAP, FR.NO_CAP, FR.NO_CAP))
    assert segments(E.envelope(free.candidates, queries)) == want
    assert all((r.connectors, r.labels, r.ended) == (0, 0, 0) for r in free.caps.collect())
    labels = FR.labels_exact(edges, queries, bounds).persist()
    assert segments(E.envelope(labels, queries)) == want and labels.count() <= exact.count()
    *_, last = FR.anytime(edges, queries, bounds, 2, 100)
    assert segments(E.envelope(last, queries)) == want


def test_caps_drop_paths_and_never_invent_any(spark):
    arcs, edges, queries, bounds, exact, pivots = setup(spark, 5)
    few = FR.layered(edges, queries, pivots, bounds, FR.Bounded(1, 2, 1, 1, 1))
    got, known = {(r.query_id, tuple(r.path)) for r in few.candidates.collect()}, {(r.query_id, tuple(r.path)) for r in exact.collect()}
    assert got < known and any(r.connectors + r.labels + r.ended for r in few.caps.collect())


def test_anytime_only_gets_better(spark):
    arcs, edges, queries, bounds, exact, _ = setup(spark, 2)
    q = queries.where("query_id = 0")
    totals = []
    for i, committed in enumerate(FR.anytime(edges, q, bounds, 1, 12)):
        if i % 4 != 3:
            continue
        parts = E.pieces(committed, q)
        grid = E.cells(parts, q)
        won = E.winners(E.in_cells(parts, grid), grid)
        totals.append(won.agg(F.sum(F.coalesce(F.col("score") + 1, F.lit(0)) * (F.col("hi") - F.col("lo")))).first()[0])
    assert len(totals) > 1 and all(b >= a - 1e-9 for a, b in zip(totals, totals[1:], strict=False))


def test_connectors_take_turns(spark):
    arcs, edges, queries, bounds, exact, _ = setup(spark, 1)
    q = queries.where("query_id = 0")
    arcs_of = P.corridor(edges, q, bounds).select("query_id", "arc_id")
    pairs = q.select("query_id", F.col("src").alias("a"), F.col("dst").alias("z"), F.col("b").cast("double").alias("b")).union(spark.createDataFrame([(0, 2, 2, 1.0)], "query_id int, a int, z int, b double"))
    ways, dropped = FR.connectors(edges, arcs_of, pairs, 100, 1000)
    rows = [r for r in ways.orderBy("slot").collect() if r.a != r.z]
    lb = {a[0]: a[4] for a in arcs}
    top = {a[0]: max(s for *_, s in a[6]) for a in arcs}
    paths = [p for p in all_paths(arcs, 1, 4) if sum(lb[i] for i in p) <= q.first().b]
    assert {tuple(r.path) for r in rows} == set(paths) and dropped.count() == 0
    fast = sorted(paths, key=lambda p: (sum(lb[i] for i in p), len(p), p))
    assert tuple(rows[0].path) == fast[0]
    dull = sorted(paths, key=lambda p: (sum(lb[i] / (1 + top[i]) for i in p), sum(lb[i] for i in p), len(p), p))
    apart = sorted(paths, key=lambda p: (sum(lb[i] * (1 + (i in fast[0])) for i in p), sum(lb[i] for i in p), len(p), p))
    turn = {p: min(4 * (fast.index(p) // 2) + (0 if fast.index(p) % 2 == 0 else 3), 4 * dull.index(p) + 1, 4 * apart.index(p) + 2) for p in paths}
    assert [tuple(r.path) for r in rows] == sorted(paths, key=lambda p: (turn[p], fast.index(p)))
    assert [(list(r.path), list(r.nodes)) for r in ways.where("a = z").collect()] == [([], [2])]


def test_open_paths_are_beaten_only_where_both_can_go(spark):
    kind = "query_id int, lo double, hi double, path array<int>, n_edges int, score bigint, travel double, travel_lo double, travel_hi double"
    at = lambda path, score, lo=3.0, hi=4.0: (0, 0.0, 1.0, path, len(path), score, 3.5, lo, hi)
    covered = spark.createDataFrame([at([1], 5), at([2], 3), at([3], 9, 2.0), at([4, 5], 5), at([6], 1)], kind)
    nodes = spark.createDataFrame([(0, [1], [1, 7]), (0, [2], [1, 7]), (0, [3], [1, 7]), (0, [4, 5], [1, 8, 7]), (0, [6], [1, 9])], "query_id int, path array<int>, nodes array<int>")
    left = {tuple(r.path) for r in E.open_undominated(covered, nodes).collect()}
    assert left == {(1,), (3,), (6,)}  # 2 scores less, 4-5 is longer; 3 arrives at other times, 6 has not been at node 7


@pytest.mark.parametrize("seed", [0])
def test_interval_labels_are_earliest_arrivals(spark, seed):
    arcs, edges, queries, bounds, exact, _ = setup(spark, seed)
    found = L.labels(edges, queries).persist()
    points = queries.select("query_id", F.explode(F.sequence(F.col("ts"), F.col("te"))).alias("t"))
    got = {(r.query_id, r.t, r.node): round(r.arrival, 6) for r in L.arrivals_at(found, points).collect()}
    assert got == {(r.query_id, r.t, r.node): round(r.arrival, 6) for r in P.point_labels(edges, queries, points).collect()}
    for r in L.pieces(found).where("query_id = 0 and size(path) > 0").collect():
        mid = (r.s + r.e) / 2
        assert abs(float(walk(arcs, r.path, mid)[0]) - (r.a0 + r.a1) / 2) < 1e-6  # the witness arrives when the label says
    segs, profiles = L.all_fastest(edges, queries)
    everything = L.exact_profiles(edges, queries, spark.createDataFrame([(0, list(p)) for p in all_paths(arcs, 1, 4)] + [(1, []), *((2, list(p)) for p in all_paths(arcs, 1, 3))], "query_id int, path array<int>"))
    assert segments(segs) == segments(E.envelope(everything, queries.withColumn("b", F.lit(1e12)), fastest=True))
    for r in segs.where("query_id = 0 and s < e").collect():
        assert r.path == best(arcs, all_paths(arcs, 1, 4), (r.s + r.e) / 2, 10**9, True)
    assert profiles.where("query_id = 0").count() >= 1


def recompute(spark, kept, new, budgets, spans, k):
    both = kept.select(*I.COLUMNS).unionByName(new.select(*I.COLUMNS)).distinct()
    coverage = both.groupBy("query_id", "path").agg(F.sum(F.col("e") - F.col("s")).alias("coverage"))
    return I.joined(I.kept_pieces(both.join(coverage, ["query_id", "path"]), spans, budgets, k))


def flat(df):
    return sorted((r.query_id, tuple(r.path), round(r.s, 6), round(r.e, 6), round(r.a0, 6), round(r.a1, 6), r.score) for r in df.collect())


@pytest.mark.parametrize("k", [2, 1000])
def test_growing_frontier_is_the_recomputed_one(spark, k):
    arcs, edges, queries, bounds, exact, _ = setup(spark, 4)
    parts = E.pieces(exact, queries).persist()
    budgets = queries.select("query_id", "b")
    paths = sorted({(r.query_id, tuple(r.path)) for r in parts.collect()})
    empty = parts.limit(0).select(*I.COLUMNS)
    kept = full = empty
    for step in range(2):
        mine = spark.createDataFrame([(q, list(p)) for i, (q, p) in enumerate(paths) if i % 2 == step], "query_id int, path array<int>")
        new = parts.join(mine, ["query_id", "path"], "left_semi")
        if step == 1:  # a part of the time only: the rest of the frontier stays as it is
            new = I._clip(new, F.lit(2.0), F.lit(5.0))
        spans = kept.select(*I.COLUMNS).unionByName(new.select(*I.COLUMNS)).groupBy("query_id").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
        full = spark.createDataFrame(recompute(spark, full, new, budgets, spans, k).collect(), parts.select(*I.COLUMNS).schema)
        kept = spark.createDataFrame(I.insert(kept, new, budgets, k).collect(), parts.select(*I.COLUMNS).schema)
        assert flat(kept.where("s < e")) == flat(full.where("s < e"))
    if k == 2:
        assert flat(I.insert(kept, empty, budgets, k)) == flat(kept)


def test_stream_keeps_a_frontier(spark, tmp_path):
    arcs, edges, queries, bounds, exact, _ = setup(spark, 4)
    parts = E.pieces(exact, queries).select(*I.COLUMNS).withColumn("n_edges", F.col("n_edges").cast("int")).persist()
    for i in range(2):
        parts.where(F.pmod(F.size("path"), F.lit(2)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    budgets = queries.select("query_id", "b")
    stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    I.running(stream, budgets, 1000, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = I.frontier(spark, str(tmp_path / "out"), 1)
    want = I.insert(parts.limit(0), parts, budgets, 1000)
    assert flat(got.where("s < e")) == flat(want.where("s < e")) and got.count()


def test_every_algorithm_answers_the_demo(spark):
    from chronopath.plans.temporal_graph import demo

    g = demo(spark)
    got = {name: [(r.s, r.e, r.path) for r in A.answer(name, g, g.queries, A.Options(pivots=2)).collect()] for name in ("layered", "exact_labels", "anytime", "all_fastest")}
    assert got["all_fastest"] == [(420.0, 430.0, [0, 1])]
    assert all(v == [(420.0, 430.0, [0, 1])] for v in got.values())
    with pytest.raises(ValueError):
        A.Options(width=0)


def test_budgets_of_fastest_profiles(spark):
    from chronopath.operators import budgets as B

    arcs, edges, queries, bounds, exact, _ = setup(spark, 0)
    got = {r.query_id: (r.least, r.most) for r in B.fastest_range(edges, queries).collect()}
    found = all_paths(arcs, 1, 4)
    times = [float(min(walk(arcs, p, t / 8)[0] for p in found)) - t / 8 for t in range(65)]
    assert got[0][0] <= min(times) + 1e-9 and got[0][1] >= max(times) - 1e-9 and got[0][1] - max(times) < 0.5
    assert got[1] == (0.0, 0.0) and got[3] == (None, None)  # where it starts; nowhere to be reached
    v = {(r.query_id, r.variant): r for r in B.variants(spark.createDataFrame([(0, 10.0, 20.0), (1, 10.0, 10.5), (2, 7.0, 7.0), (3, None, None)], "query_id int, least double, most double"), 0.25, 0.1).collect()}
    assert {k: (r.budget, r.full, r.mixed) for k, r in v.items()} == {
        (0, "MAIN"): (25.0, True, False), (0, "TIGHT"): (11.0, False, True), (1, "MAIN"): (13.125, True, False), (1, "TIGHT"): (10.125, False, True), (2, "MAIN"): (8.75, True, False), (2, "TIGHT"): (7.7, True, False),
    }


def test_gates_name_what_is_wrong(spark):
    from chronopath.operators import validate as V

    good = [(0.0, 3.0), (10.0, 3.0), (30.0, 2.0)]
    static = [(0, 1, 2, 3.0), (1, 2, 3, 3.0), (2, 3, 4, 3.0)]
    scores = [(0, [(0.0, 5.0, 1), (5.0, 30.0, 0)])]
    arcs = lambda rows: spark.createDataFrame(rows, "arc_id int, u int, v int, base double")
    functions = lambda rows: spark.createDataFrame(rows, "arc_id int, u int, v int, base double, knots array<struct<t: double, v: double>>")
    pieces = lambda rows: spark.createDataFrame(rows, "arc_id int, pieces array<struct<t0: double, t1: double, score: bigint>>")
    bad = lambda s, f, p: {r.gate: r.first_bad for r in V.payload(arcs(s), functions(f), pieces(p), 30.0, 5).collect() if r.failed}
    fine = [(*a, good) for a in static]
    assert bad(static, fine, scores) == {}
    f = [fine[0], (1, 2, 9, 4.0, [(0.0, 9.0), (2.0, 3.0), (2.0, -1.0)]), (5, 1, 1, 1.0, None)]
    assert bad(static, f, [(0, [(0.0, 4.0, 9), (5.0, 31.0, -1)])]) == {"arc_ids": 5, "functions": 2, "endpoints": 1, "base_times": 1, "two_knots": 2, "minutes_rise": 1, "travel_positive": 1, "fifo": 1, "support": 1, "score_contiguous": 0, "score_range": 0, "score_support": 0}
    gates = V.payload(arcs(static), functions(f), pieces(scores), 30.0, 5)
    with pytest.raises(ValueError, match="arc_ids: 1 of 4"):
        V.require(gates)
    assert {(r.gate, r.checked) for r in V.payload(arcs([]), functions([]), pieces([]), 30.0, 5).collect()} == {(g, 0) for g in V.GATES}
