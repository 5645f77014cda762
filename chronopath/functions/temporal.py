"""Temporal algebra as columns.

A travel-time or arrival function is ``array<struct<t, v>>``: knots in order, linear between them. A score function is
``array<struct<t0, t1, score>>``: constant on [t0, t1), the last piece owns its end. All of it stays in Spark
expressions, so nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def canonical(t: Column) -> Column:
    """Time to 12 decimals, ties to even, through a wider decimal."""
    return F.bround(t.cast("decimal(38,18)"), 12)


def same_time(a: Column, b: Column) -> Column:
    return canonical(a) == canonical(b)


def budget_up(x: Column) -> Column:
    """Budget in minutes, rounded up to a billionth."""
    return F.ceil(x.cast("decimal(28,14)") * 1_000_000_000).cast("decimal(28,0)").cast("double") / 1e9


def segments(knots: Column) -> Column:
    """Neighbouring knots as ``struct<t0, v0, t1, v1>``."""
    return let(
        knots,
        lambda f: F.zip_with(
            F.slice(f, 1, F.greatest(F.size(f) - 1, F.lit(0))), F.slice(f, 2, F.greatest(F.size(f) - 1, F.lit(0))),
            lambda a, b: F.struct(a["t"].alias("t0"), a["v"].alias("v0"), b["t"].alias("t1"), b["v"].alias("v1")),
        ),
    )


def value_at(knots: Column, t: Column) -> Column:
    """Linear interpolation; null outside the domain."""
    def between(f, x):
        a, b = f["a"], f["b"]
        return F.when(a["t"] == x, a["v"]).otherwise(a["v"] + F.try_divide((b["v"] - a["v"]) * (x - a["t"]), b["t"] - a["t"]))

    def around(f, x):
        return let(F.size(F.filter(f, lambda k: k["t"] <= x)), lambda at: let(F.struct(F.get(f, at - 1).alias("a"), F.get(f, at).alias("b")), lambda p: between(p, x)))

    return let(knots, lambda f: let(t, lambda x: around(f, x)))


def arrival_at(knots: Column, t: Column) -> Column:
    return t + value_at(knots, t)


def min_value(knots: Column) -> Column:
    return F.array_min(F.transform(knots, lambda k: k["v"]))


def max_value(knots: Column) -> Column:
    return F.array_max(F.transform(knots, lambda k: k["v"]))


def is_fifo(knots: Column) -> Column:
    """Arrivals t + v never fall."""
    return F.forall(segments(knots), lambda s: s["t1"] + s["v1"] >= s["t0"] + s["v0"])


def to_arrival(knots: Column) -> Column:
    return F.transform(knots, lambda k: F.struct(k["t"].alias("t"), (k["t"] + k["v"]).alias("v")))


def to_travel(knots: Column) -> Column:
    return F.transform(knots, lambda k: F.struct(k["t"].alias("t"), (k["v"] - k["t"]).alias("v")))


def latest_departure(knots: Column, deadline: Column) -> Column:
    """Latest t with t + v(t) <= deadline; null if there is none."""
    def best(s):
        a0, a1 = s["t0"] + s["v0"], s["t1"] + s["v1"]
        return F.when(a1 <= deadline, s["t1"]).when(a0 <= deadline, s["t0"] + F.try_divide((deadline - a0) * (s["t1"] - s["t0"]), a1 - a0))

    one = F.get(knots, F.lit(0))
    point = F.when((F.size(knots) == 1) & (one["t"] + one["v"] <= deadline), one["t"])
    return F.coalesce(F.array_max(F.transform(segments(knots), best)), point)


def restrict(knots: Column, lo: Column, hi: Column) -> Column:
    """The function on [lo, hi]; both must lie in its domain."""
    def part(f):
        knot = lambda t: F.struct(t.alias("t"), value_at(f, t).alias("v"))
        inner = F.filter(f, lambda k: (k["t"] > lo) & (k["t"] < hi))
        return F.when(lo < hi, F.concat(F.array(knot(lo)), inner, F.array(knot(hi)))).when(lo == hi, F.array(knot(lo)))

    return let(knots, part)


def compact(knots: Column) -> Column:
    """Without inner knots on the line between their neighbours."""
    def bends(k, i):
        a, b = F.get(knots, i - 1), F.get(knots, i + 1)
        return a["t"].isNull() | b["t"].isNull() | (F.abs((k["v"] - a["v"]) * (b["t"] - k["t"]) - (b["v"] - k["v"]) * (k["t"] - a["t"])) > 1e-9)

    return F.filter(knots, bends)


def thin(knots: Column, every: int) -> Column:
    """Both ends and every n-th knot."""
    return F.filter(knots, lambda k, i: (i % every == 0) | (i == F.size(knots) - 1))


def thinning_error(knots: Column, every: int) -> Column:
    """Largest difference that thinning makes at a knot."""
    return let(knots, lambda f: let(thin(f, every), lambda less: F.array_max(F.transform(f, lambda k: F.abs(k["v"] - value_at(less, k["t"]))))))


def compose(outer: Column, inner: Column) -> Column:
    """outer(inner(t)) for nondecreasing ``inner`` whose values lie in outer's domain: cuts are inner's knots and the
    times at which inner meets a knot of outer."""
    def cuts(g, f):
        return F.array_sort(F.array_distinct(F.concat(F.transform(f, lambda k: k["t"]), preimages(f, F.transform(g, lambda k: k["t"])))))

    return let(outer, lambda g: let(inner, lambda f: F.transform(cuts(g, f), lambda t: F.struct(t.alias("t"), value_at(g, value_at(f, t)).alias("v")))))


def preimages(inner: Column, values: Column) -> Column:
    """Times strictly inside rising segments at which ``inner`` takes one of ``values`` (array)."""
    return F.flatten(
        F.transform(
            segments(inner),
            lambda s: F.transform(
                F.filter(values, lambda x: (x > s["v0"]) & (x < s["v1"])),
                lambda x: s["t0"] + F.try_divide((x - s["v0"]) * (s["t1"] - s["t0"]), s["v1"] - s["v0"]),
            ),
        )
    )


def first_reach(f: Column, value: Column) -> Column:
    """Least t with f(t) >= value for nondecreasing f; null if there is none."""
    def at(s):
        return F.when(s["v0"] >= value, s["t0"]).when(s["v1"] >= value, s["t0"] + F.try_divide((value - s["v0"]) * (s["t1"] - s["t0"]), s["v1"] - s["v0"]))

    one = F.get(f, F.lit(0))
    return F.coalesce(F.array_min(F.transform(segments(f), at)), F.when((F.size(f) == 1) & (one["v"] >= value), one["t"]))


def last_reach(f: Column, value: Column) -> Column:
    """Greatest t with f(t) <= value for nondecreasing f; null if there is none."""
    def at(s):
        return F.when(s["v1"] <= value, s["t1"]).when(s["v0"] <= value, s["t0"] + F.try_divide((value - s["v0"]) * (s["t1"] - s["t0"]), s["v1"] - s["v0"]))

    one = F.get(f, F.lit(0))
    return F.coalesce(F.array_max(F.transform(segments(f), at)), F.when((F.size(f) == 1) & (one["v"] <= value), one["t"]))


def preimage(f: Column, lo: Column, hi: Column) -> Column:
    """Closed interval ``struct<s, e>`` on which nondecreasing f lies in [lo, hi], flat parts included; null if empty."""
    s, e = first_reach(f, lo), last_reach(f, hi)
    return F.when(s <= e, F.struct(s.alias("s"), e.alias("e")))


def image(knots: Column) -> Column:
    """Values that a continuous function takes: one closed interval ``struct<lo, hi>``."""
    return F.struct(min_value(knots).alias("lo"), max_value(knots).alias("hi"))


def travel_at_most(arrival: Column, budget: Column) -> Column:
    """Closed intervals ``struct<s, e>`` of each segment where arrival(t) - t <= budget."""
    def clip(s):
        d0, d1 = s["v0"] - s["t0"], s["v1"] - s["t1"]
        root = s["t0"] + F.try_divide((budget - d0) * (s["t1"] - s["t0"]), d1 - d0)
        both = F.struct(s["t0"].alias("s"), s["t1"].alias("e"))
        left = F.struct(s["t0"].alias("s"), root.alias("e"))
        right = F.struct(root.alias("s"), s["t1"].alias("e"))
        return F.when((d0 <= budget) & (d1 <= budget), both).when(d0 <= budget, left).when(d1 <= budget, right)

    return F.filter(F.transform(segments(arrival), clip), lambda x: x.isNotNull())


def joined(intervals: Column) -> Column:
    """Closed intervals ``struct<s, e>`` in order, those that touch made one."""
    empty = F.array().cast("array<struct<s: double, e: double>>")

    def grown(done: Column, x: Column) -> Column:
        last, more = F.get(done, F.size(done) - 1), F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))
        longer = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when(last["e"] >= x["s"], longer).otherwise(F.concat(done, more))

    return F.aggregate(intervals, empty, grown)


def arrival_at_most(knots: Column, limit: Column) -> Column:
    """Closed intervals of each segment where t + v(t) <= limit."""
    def clip(s):
        a0, a1 = s["t0"] + s["v0"], s["t1"] + s["v1"]
        root = s["t0"] + F.try_divide((limit - a0) * (s["t1"] - s["t0"]), a1 - a0)
        return F.when(a1 <= limit, F.struct(s["t0"].alias("s"), s["t1"].alias("e"))).when(a0 <= limit, F.struct(s["t0"].alias("s"), root.alias("e")))

    return F.filter(F.transform(segments(knots), clip), lambda x: x.isNotNull())


def _marks(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(F.transform(a, lambda k: k["t"]), F.transform(b, lambda k: k["t"]))))


def pointwise_min(a: Column, b: Column) -> Column:
    """Lower envelope of two continuous functions on the same domain, with the knots at which they cross."""
    def values(f, g):
        return F.transform(_marks(f, g), lambda t: F.struct(t.alias("t"), value_at(f, t).alias("x"), value_at(g, t).alias("y")))

    def crossing(p, q):
        d, e = p["x"] - p["y"], q["x"] - q["y"]
        at = p["t"] + F.try_divide(d * (q["t"] - p["t"]), d - e)
        low = F.least(p["x"], p["y"])
        meets = F.struct(at.alias("t"), (p["x"] + F.try_divide((q["x"] - p["x"]) * d, d - e)).alias("v"))
        return F.when(d * e < 0, F.array(F.struct(p["t"].alias("t"), low.alias("v")), meets)).otherwise(F.array(F.struct(p["t"].alias("t"), low.alias("v"))))

    def lower(both):
        n = F.size(both)
        last = F.get(both, n - 1)
        inner = F.flatten(F.zip_with(F.slice(both, 1, F.greatest(n - 1, F.lit(0))), F.slice(both, 2, F.greatest(n - 1, F.lit(0))), crossing))
        return F.concat(inner, F.array(F.struct(last["t"].alias("t"), F.least(last["x"], last["y"]).alias("v"))))

    return let(a, lambda f: let(b, lambda g: let(values(f, g), lower)))


def no_later_than(a: Column, b: Column) -> Column:
    return let(a, lambda f: let(b, lambda g: F.forall(_marks(f, g), lambda t: value_at(f, t) <= value_at(g, t))))


def same_values(a: Column, b: Column) -> Column:
    return let(a, lambda f: let(b, lambda g: F.forall(_marks(f, g), lambda t: same_time(value_at(f, t), value_at(g, t)))))


def score_at(pieces: Column, t: Column) -> Column:
    """Right-continuous value; the last piece owns its end; null outside."""
    def of(f, x):
        last = F.get(f, F.size(f) - 1)
        return F.when(x == last["t1"], last["score"]).otherwise(F.get(F.filter(f, lambda p: (p["t0"] <= x) & (x < p["t1"])), F.lit(0))["score"])

    return let(pieces, lambda f: let(t, lambda x: of(f, x)))


def score_before(pieces: Column, t: Column) -> Column:
    """Limit from the left: the value of the piece that ends at t or holds it; null at the domain's start and outside."""
    return F.get(F.filter(pieces, lambda p: (p["t0"] < t) & (t <= p["t1"])), F.lit(0))["score"]


def score_max(pieces: Column, lo: Column | None = None, hi: Column | None = None) -> Column:
    """Largest value, on all or on the closed [lo, hi]; a point takes the piece that owns it."""
    if lo is not None:
        last = F.get(pieces, F.size(pieces) - 1)["t1"]
        pieces = F.filter(pieces, lambda p: (p["t0"] <= hi) & ((p["t1"] > lo) | ((p["t1"] == lo) & (lo == last))))
    return F.array_max(F.transform(pieces, lambda p: p["score"]))


def score_restrict(pieces: Column, lo: Column, hi: Column) -> Column:
    """The pieces' parts inside [lo, hi], lo < hi."""
    inner = F.filter(pieces, lambda p: (p["t0"] < hi) & (p["t1"] > lo))
    return F.transform(inner, lambda p: F.struct(F.greatest(p["t0"], lo).alias("t0"), F.least(p["t1"], hi).alias("t1"), p["score"].alias("score")))


def positive_domain(pieces: Column) -> Column:
    """Maximal stretches ``struct<s, e>`` of positive score, [s, e) but for the domain's own end."""
    some = F.filter(pieces, lambda p: p["score"] > 0)
    empty = F.array().cast("array<struct<s: double, e: double>>")

    def grown(done: Column, p: Column) -> Column:
        last, end = F.get(done, F.size(done) - 1), p["t1"].cast("double")
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["s"].alias("s"), end.alias("e"))))
        return F.when(last["e"] == p["t0"], joined).otherwise(F.concat(done, F.array(F.struct(p["t0"].cast("double").alias("s"), end.alias("e")))))

    return F.aggregate(some, empty, grown)


def positive_in(pieces: Column, lo: Column, hi: Column) -> Column:
    return F.exists(pieces, lambda p: (p["score"] > 0) & (p["t0"] < hi) & (p["t1"] > lo))


def score_compose(pieces: Column, arrival: Column) -> Column:
    """score(arrival(t)) as pieces over the domain of ``arrival``: cuts where arrival meets a breakpoint."""
    def over(f, g):
        marks = F.array_distinct(F.concat(F.transform(f, lambda p: p["t0"]), F.transform(f, lambda p: p["t1"])))
        return score_on(F.concat(F.transform(g, lambda k: k["t"]), preimages(g, marks)), lambda t: score_at(f, value_at(g, t)))

    return let(pieces, lambda f: let(arrival, lambda g: over(f, g)))


def score_add(a: Column, b: Column) -> Column:
    """Sum of two score functions on the same domain."""
    ends = lambda p: F.concat(F.transform(p, lambda x: x["t0"]), F.transform(p, lambda x: x["t1"]))
    return let(a, lambda f: let(b, lambda g: score_on(F.concat(ends(f), ends(g)), lambda t: score_at(f, t) + score_at(g, t))))


def score_on(cuts: Column, value) -> Column:
    """Pieces between the cuts with the value at their middle."""
    def between(c):
        n = F.greatest(F.size(c) - 1, F.lit(0))
        return F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda s, e: F.struct(s.alias("t0"), e.alias("t1"), value((s + e) / 2).alias("score")))

    return let(F.array_sort(F.array_distinct(cuts)), between)


def grid(lo: Column, hi: Column, step: Column) -> Column:
    """Departures lo, lo + step, … as far as hi."""
    return F.sequence(lo, hi, step)


def loopless(nodes: Column) -> Column:
    return F.size(F.array_distinct(nodes)) == F.size(nodes)


def abs_linear_integral(d0: Column, d1: Column, width: Column) -> Column:
    """Integral of |linear from d0 to d1| over a width, across a sign change too."""
    return F.when(d0 * d1 >= 0, (F.abs(d0) + F.abs(d1)) / 2 * width).otherwise(F.try_divide(d0 * d0 + d1 * d1, F.abs(d0) + F.abs(d1)) / 2 * width)
