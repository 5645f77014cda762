"""Earliest-arrival functions with their paths, in Arrow batches: through an arc, and the lowest of several.

A function is a list of pieces ``(s, e, a0, a1, path)`` in order: over [s, e] the path arrives from a0 to a1. Where one
instant has a winner of its own it is a piece with s = e.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa

FUNCTION = "array<struct<s: double, e: double, a0: double, a1: double, path: array<int>>>"
_KIND = pa.list_(pa.struct([("s", pa.float64()), ("e", pa.float64()), ("a0", pa.float64()), ("a1", pa.float64()), ("path", pa.list_(pa.int32()))]))
_DIGITS = 9


def _list(x: list[dict]) -> list[tuple]:
    return [(p["s"], p["e"], p["a0"], p["a1"], tuple(p["path"])) for p in x]


def _dicts(x: list[tuple]) -> list[dict]:
    return [{"s": s, "e": e, "a0": a, "a1": z, "path": list(p)} for s, e, a, z, p in x]


def value(piece: tuple, t: float) -> float:
    s, e, a, z, _ = piece
    return a if t <= s else z if t >= e else a + (z - a) * (t - s) / (e - s)


def _order(piece: tuple, t: float) -> tuple:
    return round(value(piece, t), _DIGITS), len(piece[4]), piece[4]


def lower(f: list[tuple], g: list[tuple]) -> list[tuple]:
    """The lowest of two functions; equal values go to fewer arcs, then to the smaller path."""
    if not f or not g:
        return f or g
    marks = {round(t, 12) for p in (*f, *g) for t in p[:2]}
    i = j = 0
    while i < len(f) and j < len(g):
        p, q = f[i], g[j]
        lo, hi = max(p[0], q[0]), min(p[1], q[1])
        if lo < hi:
            d, e = value(p, lo) - value(q, lo), value(p, hi) - value(q, hi)
            if d * e < 0:
                marks.add(round(lo + d * (hi - lo) / (d - e), 12))
        if p[1] <= q[1]:
            i += 1
        else:
            j += 1
    marks = sorted(marks)
    starts = [[p[0] for p in x] for x in (f, g)]

    def at(t: float, lo: float, hi: float) -> tuple | None:
        """Winner among the pieces that hold all of [lo, hi], judged at t."""
        found = []
        for x, s in zip((f, g), starts, strict=True):
            k = bisect_left(s, lo + 1e-12)
            while k and x[k - 1][1] >= lo - 1e-12:  # pieces are in order, a few share a border
                k -= 1
                if x[k][0] <= lo + 1e-12 and x[k][1] >= hi - 1e-12:
                    found.append(x[k])
            if k and x[k - 1][1] >= hi - 1e-12:
                found.append(x[k - 1])
        return min(found, key=lambda p: _order(p, t)) if found else None

    out: list[tuple] = []
    for n, t in enumerate(marks):
        if w := at(t, t, t):
            out.append((t, t, value(w, t), value(w, t), w[4]))
        if n + 1 < len(marks) and (w := at((t + marks[n + 1]) / 2, t, marks[n + 1])):
            out.append((t, marks[n + 1], value(w, t), value(w, marks[n + 1]), w[4]))
    return joined(out)


def joined(parts: list[tuple]) -> list[tuple]:
    """Neighbouring pieces of one path on one line as one; instants belong to a neighbour of their path."""
    out: list[tuple] = []
    for p in parts:
        if out and out[-1][4] == p[4] and abs(out[-1][1] - p[0]) < 1e-12:
            s, e, a, z, path = out[-1]
            if p[0] == p[1] and round(z - p[2], _DIGITS) == 0:
                continue
            if s == e and round(z - p[2], _DIGITS) == 0:
                out[-1] = (p[0], p[1], p[2], p[3], path)
                continue
            if round(z - p[2], _DIGITS) == 0 and s < e and abs((z - a) * (p[1] - p[0]) - (p[3] - p[2]) * (e - s)) < 1e-9 * max(1.0, p[1] - s):
                out[-1] = (s, p[1], a, p[3], path)
                continue
        out.append(p)
    return out


def through_arc(f: list[tuple], knots: list[tuple[float, float]], arc: int, budget: float | None) -> list[tuple]:
    """Arrivals at the arc's end: entered at the function's arrivals while its travel time is known, within budget."""
    out = []
    for s, e, a, z, path in f:
        if s == e:
            cuts = [(s, a)]
        else:
            inner = [t for t, _ in knots if a < t < z]
            cuts = [(s, a), *((s + (t - a) * (e - s) / (z - a), t) for t in inner), (e, z)]
        got = [(t, x + v) for t, x in cuts if (v := _travel(knots, x)) is not None]
        more = (*path, arc)
        if s == e and got:
            got = [got[0], got[0]]
        for (t0, v0), (t1, v1) in zip(got, got[1:], strict=False):
            if budget is not None:  # travel time is linear: the part where it keeps the budget
                d0, d1 = v0 - t0 - budget, v1 - t1 - budget
                if d0 > 1e-9 and d1 > 1e-9:
                    continue
                if d0 > 1e-9 or d1 > 1e-9:
                    t = t0 + d0 * (t1 - t0) / (d0 - d1)
                    v = v0 + (v1 - v0) * (t - t0) / (t1 - t0)
                    (t0, v0), (t1, v1) = ((t, v), (t1, v1)) if d0 > 1e-9 else ((t0, v0), (t, v))
            out.append((t0, t1, v0, v1, more))
    return out


def _travel(knots: list[tuple[float, float]], t: float) -> float | None:
    if not knots[0][0] <= t <= knots[-1][0]:
        return None
    i = min(max(1, bisect_left([k[0] for k in knots], t)), len(knots) - 1) if len(knots) > 1 else 0
    if len(knots) == 1:
        return knots[0][1]
    (t0, v0), (t1, v1) = knots[i - 1], knots[i]
    return v0 + (v1 - v0) * (t - t0) / (t1 - t0)


def below(f: list[tuple], border: list[tuple] | None) -> list[tuple]:
    """Pieces that lie under the border somewhere, or where it has none."""
    if not border:
        return f
    out = []
    for p in f:
        over = [b for b in border if b[0] <= p[1] and p[0] <= b[1]]
        reach = sorted((b[0], b[1]) for b in over)
        covered = bool(reach) and reach[0][0] <= p[0] and max(e for _, e in reach) >= p[1] and all(b[0] <= max(e for _, e in reach[: i + 1]) + 1e-9 for i, b in enumerate(reach[1:]))
        marks = {p[0], p[1], *(t for b in over for t in b[:2] if p[0] <= t <= p[1])}
        if not covered or any(value(p, t) < value(b, t) - 1e-9 for t in marks for b in over if b[0] <= t <= b[1]):
            out.append(p)
    return out


def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``fn`` after the arc in ``arc_id`` and ``_k``, within ``b`` (null: no limit) and only where under ``border``."""
    for r in batches:
        out = []
        for f, k, arc, b, border in zip(*(r.column(c).to_pylist() for c in ("fn", "_k", "arc_id", "b", "border")), strict=True):
            got = through_arc(_list(f), [(x["t"], x["v"]) for x in k], arc, b)
            out.append(_dicts(joined(below(got, border and _list(border)))))
        yield pa.RecordBatch.from_pydict({"query_id": r.column("query_id"), "node": r.column("node"), "fn": pa.array(out, _KIND)})


def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lowest of all functions of a query and node, rows in that order and each node's old one (``old``) first; ``new``
    tells whether that changed. One function is held at a time, however many arcs lead to a node."""
    key, held, was = None, [], []
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        got = pa.RecordBatch.from_pydict({"query_id": pa.array([d[0][0] for d in done], pa.int32()), "node": pa.array([d[0][1] for d in done], pa.int32()), "fn": pa.array([_dicts(d[1]) for d in done], _KIND), "new": pa.array([d[2] for d in done], pa.bool_())})
        done.clear()
        return got

    for r in batches:
        for q, node, f, old in zip(*(r.column(c).to_pylist() for c in ("query_id", "node", "fn", "old")), strict=True):
            if (q, node) != key:
                if held:
                    done.append((key, held, held != was))
                key, held, was = (q, node), [], []
            f = _list(f)
            if old:
                was = f
            held = lower(held, f)
        if len(done) >= 500:
            yield out()
    if held:
        done.append((key, held, held != was))
    if done:
        yield out()
