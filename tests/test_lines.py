"""Lines near lines against brute force: distances end by end, overlaps by dense samples, places by all segments."""

import math

import numpy as np

from chronopath.functions.segments import ENDS, near
from chronopath.operators import spatial as S

KIND = "{} int, points array<struct<x: double, y: double>>"


def point(p, a, b):
    d = b - a
    t = 0.0 if not d @ d else min(1.0, max(0.0, (p - a) @ d / (d @ d)))
    return math.hypot(*(p - a - t * d)), t


def steps(line):
    return [(np.array(a), np.array(b)) for a, b in zip(line, line[1:], strict=False) if a != b]


def crosses(a, b, c, d):
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


def apart(e, s):
    return min(0.0 if crosses(a, b, c, d) else min(point(a, c, d)[0], point(b, c, d)[0], point(c, a, b)[0], point(d, a, b)[0]) for a, b in steps(e) for c, d in steps(s))


def along(e, where):
    for a, b in steps(e):
        n = math.hypot(*(b - a))
        if where <= n:
            return a + (b - a) * where / n
        where -= n
    return np.array(e[-1])


def length(e):
    return sum(math.hypot(*(b - a)) for a, b in steps(e))


def turn(e, s):
    way = lambda x: math.degrees(math.atan2(x[-1][0] - x[0][0], x[-1][1] - x[0][1]))
    d = abs(way(e) - way(s)) % 360
    return min(d, 360 - d)


def place(m, s):
    best, off = None, 0.0
    for a, b in steps(s):
        n = math.hypot(*(b - a))
        d, t = point(m, a, b)
        best = min(best or (1e18, 0), (round(d, 9), off + t * n))
        off += n
    return best[1]


def test_ordered_arcs_against_brute_force(spark):
    rng = np.random.default_rng(5)
    walk = lambda n, size: [tuple(map(float, p)) for p in np.cumsum(np.r_[[rng.uniform(0, 300, 2)], rng.normal(0, size, (n, 2))], 0).round(3)]
    edges = {i: walk(rng.integers(1, 4), 25) for i in range(40)} | {100: [(5.0, 5.0)], 101: [(7.0, 7.0), (7.0, 7.0)], 102: [(0.0, 0.0), (400.0, 0.0)], 103: []}
    shapes = {i: walk(rng.integers(1, 12), 60) for i in range(8)} | {50: [(0.0, 10.0), (200.0, 10.0), (200.0, 10.0), (400.0, 10.0)], 51: [(1.0, 1.0)]}
    frame = lambda x, name: spark.createDataFrame([(k, v) for k, v in x.items()], KIND.format(name)).repartition(3)
    radius, overlap, angle = 20.0, 0.3, 70.0
    pairs = {(r.arc_id, r.shape): r for r in S.line_pairs(frame(edges, "arc_id"), frame(shapes, "shape"), radius).collect()}
    want = {(i, k): apart(e, s) for i, e in edges.items() for k, s in shapes.items() if steps(e) and steps(s) and apart(e, s) <= radius}
    assert pairs.keys() == want.keys() and all(abs(pairs[k].distance - v) < 1e-6 for k, v in want.items())
    for (i, k), r in pairs.items():
        ts = (np.arange(1500) + 0.5) / 1500 * length(edges[i])
        near = np.mean([min(point(along(edges[i], t), a, b)[0] for a, b in steps(shapes[k])) <= radius for t in ts])
        assert abs(near - r.overlap) < 3e-3, (i, k)
    got = {(r.shape, r.arc_id): r for r in S.ordered_arcs(frame(edges, "arc_id"), frame(shapes, "shape"), radius, overlap, angle).collect()}
    assert got.keys() == {(k, i) for (i, k), r in pairs.items() if r.overlap >= overlap and turn(edges[i], shapes[k]) <= angle} and (50, 102) in got
    for k in shapes:
        mine = sorted((round(place(along(edges[i], length(edges[i]) / 2), shapes[k]), 6), i) for s, i in got if s == k)
        assert [got[k, i].arc_order for _, i in mine] == list(range(len(mine)))
        assert all(abs(got[k, i].position - p) < 1e-5 for p, i in mine)


def test_copies_of_lines_are_compared_once(spark, monkeypatch):
    line = [(0.0, 0.0), (200.0, 0.0), (400.0, 10.0)]
    edges = {i: [(50.0 + 100 * (i % 2), 5.0), (140.0 + 100 * (i % 2), 5.0)] for i in range(60)}
    shapes = {i: line for i in range(1500)} | {5000: line[:2]}
    seen, pairs = [], S.line_pairs
    monkeypatch.setattr(S, "line_pairs", lambda e, s, r: seen.append((e.count(), s.count())) or pairs(e, s, r))
    frame = lambda x, name: spark.createDataFrame([(k, v) for k, v in x.items()], KIND.format(name)).repartition(3)
    got = S.ordered_arcs(frame(edges, "arc_id"), frame(shapes, "shape"), 20.0, 0.3, 70.0).select("shape", "arc_id", "arc_order").collect()
    order = [*range(0, 60, 2), *range(1, 60, 2)]
    assert seen == [(2, 2)]
    assert sorted(map(tuple, got)) == sorted((k, i, order.index(i)) for k in shapes for i in edges)


def test_a_crowded_cell_is_dealt_to_many_tasks(spark):
    """5,000 and 3,000 rows of one cell: no task has more than the pairs of a block or two, and none is lost."""
    a, b = (spark.range(n).selectExpr(f"id as {c}", "0L as _cx", "0L as _cy") for n, c in ((5000, "a"), (3000, "b")))
    met = S._meet(a, b, 1e6)
    per = [r["count"] for r in met.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()]
    assert sum(per) == 15_000_000 and len(per) > 3 and max(per) < 9_000_000
    assert met.selectExpr("a * 3000 + b as x").agg({"x": "sum"}).first()[0] == sum(range(15_000_000))


def test_copies_are_paired_in_many_tasks_after_rounding(spark):
    """6,000 copies of an edge by 6,000 of a shape: no task lists more than a few blocks, none is lost, and measures are rounded once."""
    line = "array(struct({} as x, {} as y), struct({} as x, {} as y)) as points"
    edges = spark.range(6000).selectExpr("id as arc_id", line.format("10D", "1D", "20D", "3D"))
    shapes = spark.range(6000).selectExpr("id as shape", line.format("0D", "0D", "100D", "7D"))
    plain, got = (S.ordered_arcs(edges, shapes, 20.0, 0.3, 70.0, *digits) for digits in ((), (4,)))
    per = [r["count"] for r in got.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()]
    assert sum(per) == 36_000_000 and len(per) > 2 and max(per) < 30_000_000
    assert got.where("arc_id <> arc_order").count() == 0
    measures = ["distance", "overlap", "turn", "position"]
    pair = lambda x, f: tuple(x.where("shape = 4321 and arc_id = 1234").selectExpr(*[f.format(c) for c in measures]).first())
    assert pair(got, "{}") == pair(plain, "round({}, 4)") != pair(plain, "{}")


def test_the_query_rounds_before_copies_are_paired(spark):
    from chronopath.plans.workload_queries import d11_ordered_arcs

    plan = d11_ordered_arcs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "round(" not in plan.split("Generate")[0]


def test_stretches_of_segments(spark):
    """Segments that touch, cross, run side by side or miss, in batches of Arrow rows, against dense samples."""
    rng = np.random.default_rng(8)
    ends = [*rng.integers(-6, 7, (300, 8)).astype(float), np.array([0.0, 0, 9, 0, 0, 3, 9, 3]), np.array([0.0, 0, 0, 9, 3, 0, 3, 9]), np.array([0.0, 0, 9, 0, 0, 0, 9, 0]), np.array([0.0, 0, 9, 0, 4, -5, 4, 5])]
    ends = [e for e in ends if (e[0], e[1]) != (e[2], e[3]) and (e[4], e[5]) != (e[6], e[7])]
    rows = [(str(i), i, *map(float, e), 5.0, math.hypot(e[2] - e[0], e[3] - e[1])) for i, e in enumerate(ends)]
    df = spark.createDataFrame(rows, f"arc_id string, shape int, {', '.join(c + ' double' for c in ENDS)}, poff double, plen double")
    got = {r.shape: r for r in df.mapInArrow(near(3.0), "arc_id string, shape int, distance double, _lo double, _hi double").collect()}
    for i, e in enumerate(ends):
        a, b, c, d = (e[k : k + 2] for k in (0, 2, 4, 6))
        apart_ = 0.0 if crosses(a, b, c, d) else min(point(a, c, d)[0], point(b, c, d)[0], point(c, a, b)[0], point(d, a, b)[0])
        assert (i in got) == (apart_ <= 3.0)
        if i in got:
            size = math.hypot(*(b - a))
            hit = [t for t in np.linspace(0, 1, 2001) if point(a + t * (b - a), c, d)[0] <= 3.0]
            assert got[i].arc_id == str(i) and abs(got[i].distance - apart_) < 1e-9
            assert not hit or abs(got[i]._lo - 5 - hit[0] * size) < 0.01 * size and abs(got[i]._hi - 5 - hit[-1] * size) < 0.01 * size
