"""Queries without SQL against brute force over all that they should cover."""

import pytest

from chronopath import catalog
from chronopath.plans.temporal_graph import QUERIES, graph

SF = "/root/testdata/sf0.001"


def test_candidates_of_every_customer(spark):
    c = spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal").collect()
    want = {}
    for s in c:
        near = [d for d in c if d.c_nationkey == s.c_nationkey]
        poor = sum(d.c_acctbal < 0 and d.c_custkey != s.c_custkey for d in near)
        want[s.c_custkey] = min(3, len(near) - poor - 1), poor, len(near)
    assert {r.src: (r.accepted, r.poor, r.seen) for r in catalog.QUERIES["j1_all_candidates"](spark, SF).collect()} == want


@pytest.fixture(scope="module")
def arcs(spark):
    return [(r.arc_id, r.u, r.v, [(k.t, k.v) for k in r.knots], [(p.t0, p.t1, p.score) for p in r.pieces]) for r in graph(spark, SF).edges.collect()]


def travel(knots, t):
    return next(v0 + (v1 - v0) * (t - t0) / (t1 - t0) for (t0, v0), (t1, v1) in zip(knots, knots[1:], strict=False) if t0 <= t <= t1)


def departures(ts, te):
    return sorted({*range(ts, te + 1, 10), te})


def best_path(arcs, src, dst, t, b):
    stack, found = [((), (src,), float(t), 0)], []
    while stack:
        path, nodes, a, score = stack.pop()
        if nodes[-1] == dst:
            found.append((-score, round(a - t, 9), len(path), path))
            continue
        for i, u, v, knots, pieces in arcs:
            if u == nodes[-1] and v not in nodes and (at := a + travel(knots, a)) - t <= b + 1e-9:
                stack.append(((*path, i), (*nodes, v), at, score + next(s for t0, t1, s in pieces if t0 <= a < t1)))
    return "-".join(map(str, min(found)[3])) if found else None


def test_sampled_answers_of_every_query(spark, arcs):
    got = {(r.query_id, r.s): (r.e, r.e_inc, r.path) for r in catalog.QUERIES["i26_all_sampled"](spark, SF).collect()}
    want = {}
    for q, src, dst, ts, te, b in QUERIES:
        at = departures(ts, te)
        for t, e in zip(at, [*at[1:], te], strict=True):
            want[q, float(t)] = float(e), t == te, best_path(arcs, src, dst, t, b)
    assert got == want


def latest(knots, d):
    """Latest start that arrives by d; arrivals never fall."""
    lo, hi = 0.0, knots[-1][0]
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid + travel(knots, mid) <= d else (lo, mid)
    return lo


def test_labels_within_the_queries_own_budgets(spark, arcs):
    want, want_latest = {}, {}
    for q, src, dst, ts, te, b in QUERIES:
        for t in departures(ts, te):
            best, front = {src: float(t)}, [src]
            while front:
                n = front.pop()
                for _, u, v, knots, _ in arcs:
                    if u == n and (a := best[u] + travel(knots, best[u])) <= t + b + 1e-9 and a < best.get(v, 1e9) - 1e-9:
                        best[v] = a
                        front.append(v)
            want |= {(q, t, n): a for n, a in best.items()}
        best, front = {dst: float(te)}, [dst]
        while front:
            n = front.pop()
            for _, u, v, knots, _ in arcs:
                if v == n and (s := latest(knots, best[v])) >= te - b - 1e-9 and s > best.get(u, -1) + 1e-9:
                    best[u] = s
                    front.append(u)
        want_latest |= {(q, te, n): s for n, s in best.items()}
    got = {(r.query_id, r.t, r.node): r.arrival for r in catalog.QUERIES["i13_point_labels"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=1e-5)
    got = {(r.query_id, r.deadline, r.node): r.departure for r in catalog.QUERIES["i14_latest_labels"](spark, SF).collect()}
    assert got == pytest.approx(want_latest, abs=1e-5)
