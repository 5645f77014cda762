"""Labels settled cell by cell against a plain search of the whole graph."""

import heapq
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_profiles import SCHEMA

from chronopath.operators import cells as C
from chronopath.operators import paths as P
from chronopath.plans.materialize import checkpoint, forget

N = 30
QUERY = "query_id int, src int, dst int, b int"


def graph(seed):
    """Arcs in both directions, loops, parallel arcs and many equal least times; the last node has no arcs."""
    rng = np.random.default_rng(seed)
    arcs = []
    for i in range(90):
        u, v = (int(x) for x in rng.integers(0, N - 1, 2))
        knots = [(0.0, float(rng.integers(1, 4)))]
        for t in (4.0, 9.0, 15.0, 60.0):
            knots.append((t, float(max(1, knots[-1][1] + rng.integers(-2, 3)))))
        arcs.append((i, u, v, 1.0, min(v for _, v in knots), knots, [(0.0, 60.0, 0)]))
    return arcs


def search(start, limit, step):
    """Dijkstra over (cost, hops, last arc)."""
    best, heap = {start[0]: (start[1], 0, -1)}, [((start[1], 0, -1), start[0])]
    while heap:
        label, node = heapq.heappop(heap)
        if best[node] != label:
            continue
        for to, cost, arc in step(node, label[0]):
            new = cost, label[1] + 1, arc
            if cost <= limit and (to not in best or new < best[to]):
                best[to] = new
                heapq.heappush(heap, (new, to))
    return best


def least(arcs, forward=True, barred=()):
    def step(node, cost):
        for i, u, v, _, lb, _, _ in arcs:
            a, z = (u, v) if forward else (v, u)
            if a == node and i not in barred:
                yield z, cost + lb, i

    return step


def arrivals(arcs):
    def step(node, t):
        for i, u, v, _, _, knots, _ in arcs:
            for (t0, v0), (t1, v1) in zip(knots, knots[1:], strict=False):
                if u == node and t0 <= t <= t1:
                    yield v, t + v0 + (v1 - v0) * (t - t0) / (t1 - t0), i
                    break

    return step


def departures(arcs):
    def step(node, cost):
        for i, u, v, _, _, knots, _ in arcs:
            found = [t1 if t1 + v1 <= -cost else t0 + (-cost - t0 - v0) * (t1 - t0) / (t1 + v1 - t0 - v0) for (t0, v0), (t1, v1) in zip(knots, knots[1:], strict=False) if t0 + v0 <= -cost]
            if v == node and found:
                yield u, -max(found), i

    return step


@pytest.mark.parametrize("size", [3, 100])
def test_static_labels_with_ties(spark, size, monkeypatch):
    monkeypatch.setattr(C, "TOGETHER", 2)  # several tasks settle one cell
    arcs = graph(size)
    edges = spark.createDataFrame(arcs, SCHEMA)
    queries = spark.createDataFrame([(q, q % 5, 20 + q % 4, 3 + q) for q in range(7)] + [(90, N - 1, 0, 4), (91, None, 0, 4), (92, 0, 1, None), (0, 0, 20, 3)], QUERY)
    cells = C.by_number(spark.range(N - 5).select(F.col("id").alias("node")), size)  # the last ones are cells of their own
    barred = spark.createDataFrame([(q, i) for q in range(7) for i in range(q, 90, 9)], "query_id int, arc_id int")
    for forward in (True, False):
        for without in (None, barred):
            starts = queries.select("query_id", F.col("src").alias("node"), "b")
            got = {(r.query_id, r.node): (r.cost, r.hops, r.arc_id) for r in P.lower_bounds(edges, starts, forward, cells, without).collect()}
            want = {}
            for q, src, b in [(q, q % 5, 3 + q) for q in range(7)] + [(90, N - 1, 4)]:
                no = {i for i in range(q, 90, 9)} if without is not None and q < 7 else ()
                want |= {(q, n): label for n, label in search((src, 0.0), b, least(arcs, forward, no)).items()}
            assert got == want


@pytest.mark.parametrize("size", [4, None])
def test_times(spark, size):
    arcs = graph(3)
    edges = spark.createDataFrame(arcs, SCHEMA)
    queries = spark.createDataFrame([(0, 0, 9, 12), (1, 3, 7, 9)], QUERY)
    cells = C.by_number(spark.range(N).select(F.col("id").alias("node")), size) if size else None
    points = spark.createDataFrame([(0, 0.0), (0, 3.5), (1, 8.0), (1, 55.0)], "query_id int, t double")
    got = {(r.query_id, r.t, r.node): round(r.arrival, 9) for r in P.point_labels(edges, queries, points, cells).collect()}
    assert got == {(q, t, n): round(x[0], 9) for q, src, b, ts in ((0, 0, 12, (0.0, 3.5)), (1, 3, 9, (8.0, 55.0))) for t in ts for n, x in search((src, t), t + b, arrivals(arcs)).items()}
    ends = points.withColumnRenamed("t", "deadline")
    got = {(r.query_id, r.deadline, r.node): round(r.departure, 9) for r in P.latest_labels(edges, queries, ends, cells).collect()}
    assert got == {(q, t, n): round(-x[0], 9) for q, dst, b, ts in ((0, 9, 12, (0.0, 3.5)), (1, 7, 9, (8.0, 55.0))) for t in ts for n, x in search((dst, -t), b - t, departures(arcs)).items()}


def test_no_rows(spark):
    edges = spark.createDataFrame(graph(0), SCHEMA)
    none = spark.createDataFrame([], "query_id int, node int, b int")
    assert P.lower_bounds(edges, none).count() == 0
    one = spark.createDataFrame([(0, 2, 5)], "query_id int, node int, b int")
    assert [tuple(r) for r in P.lower_bounds(edges.limit(0), one).collect()] == [(0, 2, 0.0, 0, -1)]


def test_cells_by_place_hold_no_more_than_asked(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((400, 2)))] + [(i, 0.5, 0.5) for i in range(400, 900)]
    rows += [(900, None, 1.0), (901, float("nan"), 1.0), (902, float("inf"), 1.0)]
    got = {r.node: r.cell for r in C.by_place(spark.createDataFrame(rows, "node int, x double, y double"), 50).collect()}
    assert set(got) == set(range(900))
    held = {}
    for n, c in got.items():
        held.setdefault(c, []).append(n)
    assert max(len(v) for k, v in held.items() if v[0] < 400) <= 50 and max(map(len, held.values())) < 100  # one place is dealt by hash
    near = [v for v in held.values() if len(v) > 5 and v[0] < 400]
    at = {i: (x, y) for i, x, y in rows}
    assert all(max(at[n][0] for n in v) - min(at[n][0] for n in v) <= 0.51 for v in near)
    same = C.by_place(spark.createDataFrame([(i, 1.0, 2.0) for i in range(5)], "node int, x double, y double"), 50)
    assert same.select("cell").distinct().count() == 1


def test_forget_deletes_the_files(spark):
    df = checkpoint(spark.range(10))
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.exists(file)
    forget(df)
    assert not os.path.exists(file)
