"""Path profiles row by row, in Arrow batches: composing long functions as nested column expressions makes plans that
grow with every knot, so this one step runs in Python over batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ARRIVAL = "array<struct<t: double, v: double>>"
PIECES = "array<struct<t0: double, t1: double, score: bigint>>"


def meets(t: np.ndarray, v: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Times strictly inside segments at which the function takes one of ``values``."""
    out = []
    for i in range(len(t) - 1):
        lo, hi = sorted((v[i], v[i + 1]))
        x = values[(values > lo) & (values < hi)]
        out.append(t[i] + (x - v[i]) * (t[i + 1] - t[i]) / (v[i + 1] - v[i]) if hi > lo else x[:0])
    return np.concatenate(out) if out else np.empty(0)


def straight(t: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without inner knots on the line between their neighbours."""
    if len(t) < 3:
        return t, v
    bend = np.abs((v[1:-1] - v[:-2]) * (t[2:] - t[1:-1]) - (v[2:] - v[1:-1]) * (t[1:-1] - t[:-2])) > 1e-9
    keep = np.r_[True, bend, True]
    return t[keep], v[keep]


def score_at(bounds: np.ndarray, score: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Right-continuous; the last piece owns its end."""
    return score[np.clip(np.searchsorted(bounds, t, "right") - 1, 0, len(score) - 1)]


def extend(at, av, bounds, score, kt, kv, pt, ps):
    """One arc more: arrival (at, av) and scores (bounds, score) over the root departure; the arc's travel-time knots
    (kt, kv) and score pieces (pt bounds, ps). The score counts at entry, the arrival is that of the arc."""
    cuts = np.unique(np.r_[at, meets(at, av, kt)])
    entry = np.interp(cuts, at, av)
    marks = np.unique(np.r_[bounds, meets(at, av, pt)])
    if len(marks) > 1:
        mid = (marks[:-1] + marks[1:]) / 2
        total = score_at(bounds, score, mid) + score_at(pt, ps, np.interp(mid, at, av))
    else:
        marks, total = np.r_[marks, marks], score_at(bounds, score, marks) + score_at(pt, ps, np.interp(marks, at, av))
    return *straight(cuts, entry + np.interp(entry, kt, kv)), marks, total


def _knots(x: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([k["t"] for k in x]), np.array([k["v"] for k in x])


def _steps(x: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([x[0]["t0"], *(p["t1"] for p in x)]), np.array([p["score"] for p in x], np.int64)


def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace ``arrival`` and ``pieces`` by those after the arc in ``_k`` and ``_p``."""
    for b in batches:
        arrival, pieces = [], []
        for a, p, k, s in zip(*(b.column(c).to_pylist() for c in ("arrival", "pieces", "_k", "_p")), strict=True):
            t, v, bounds, score = extend(*_knots(a), *_steps(p), *_knots(k), *_steps(s))
            arrival.append([{"t": x, "v": y} for x, y in zip(t.tolist(), v.tolist(), strict=True)])
            pieces.append([{"t0": x, "t1": y, "score": z} for x, y, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), score.tolist(), strict=True)])
        cols = {c: b.column(c) for c in b.schema.names if c not in ("arrival", "pieces", "_k", "_p")}
        cols["arrival"] = pa.array(arrival, pa.list_(pa.struct([("t", pa.float64()), ("v", pa.float64())])))
        cols["pieces"] = pa.array(pieces, pa.list_(pa.struct([("t0", pa.float64()), ("t1", pa.float64()), ("score", pa.int64())])))
        yield pa.RecordBatch.from_pydict(cols)


def _pieces_of(bounds: np.ndarray, score: np.ndarray) -> list[dict]:
    return [{"t0": x, "t1": y, "score": z} for x, y, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), score.tolist(), strict=True)]


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace ``arrival`` and ``pieces`` by those after all arcs of ``_ks`` and ``_ps``, in order."""
    for b in batches:
        arrival, pieces = [], []
        for a, p, ks, ss in zip(*(b.column(c).to_pylist() for c in ("arrival", "pieces", "_ks", "_ps")), strict=True):
            state = *_knots(a), *_steps(p)
            for k, s in zip(ks, ss, strict=True):
                state = extend(*state, *_knots(k), *_steps(s))
            arrival.append([{"t": x, "v": y} for x, y in zip(state[0].tolist(), state[1].tolist(), strict=True)])
            pieces.append(_pieces_of(state[2], state[3]))
        cols = {c: b.column(c) for c in b.schema.names if c not in ("arrival", "pieces", "_ks", "_ps")}
        cols["arrival"] = pa.array(arrival, pa.list_(pa.struct([("t", pa.float64()), ("v", pa.float64())])))
        cols["pieces"] = pa.array(pieces, pa.list_(pa.struct([("t0", pa.float64()), ("t1", pa.float64()), ("score", pa.int64())])))
        yield pa.RecordBatch.from_pydict(cols)


def within_budget(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Linear pieces ``(query_id, path, s, e, a0, a1, score)`` of profiles whose travel time stays within ``b``."""
    for r in batches:
        rows: dict[str, list] = {c: [] for c in ("query_id", "path", "s", "e", "a0", "a1", "score")}
        for q, path, a, p, b in zip(*(r.column(c).to_pylist() for c in ("query_id", "path", "arrival", "pieces", "b")), strict=True):
            (t, v), (bounds, score) = _knots(a), _steps(p)
            c = np.unique(np.round(np.r_[t, bounds, meets(t, v - t, np.array([float(b)]))], 12))
            s, e = (c[:-1], c[1:]) if len(c) > 1 else (c, c)
            a0, a1, mid = np.interp(s, t, v), np.interp(e, t, v), (s + e) / 2
            ok = np.flatnonzero((a0 + a1) / 2 - mid <= b + 1e-9)
            z = score_at(bounds, score, mid)
            for name, x in (("s", s), ("e", e), ("a0", a0), ("a1", a1), ("score", z)):
                rows[name] += x[ok].tolist()
            rows["query_id"] += [q] * len(ok)
            rows["path"] += [path] * len(ok)
        kinds = {"query_id": r.schema.field("query_id").type, "path": pa.list_(pa.int32()), "score": pa.int64()}
        yield pa.RecordBatch.from_pydict({k: pa.array(x, kinds.get(k, pa.float64())) for k, x in rows.items()})
