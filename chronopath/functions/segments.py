"""How segments lie to each other, in Arrow batches: their distance, and the stretch of one that is near the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

ENDS = [p + c for p in "ps" for c in ("x0", "y0", "x1", "y1")]
Segment = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _part(a: np.ndarray, b: np.ndarray, none: float = np.nan) -> np.ndarray:
    """a / b, ``none`` where b is 0."""
    return np.divide(a, b, out=np.full_like(a, none), where=b != 0)


def _from_point(x: np.ndarray, y: np.ndarray, s: Segment) -> np.ndarray:
    """Distance of points from segments."""
    ax, ay, bx, by = s
    dx, dy = bx - ax, by - ay
    t = np.clip(_part((x - ax) * dx + (y - ay) * dy, dx * dx + dy * dy, 0.0), 0.0, 1.0)
    u, v = x - ax - t * dx, y - ay - t * dy
    return np.sqrt(u * u + v * v)


def distance(p: Segment, s: Segment) -> np.ndarray:
    """0 where segments cross, else the distance of an end from the other one."""
    side = lambda s, x, y: (s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0])
    cross = (side(p, s[0], s[1]) * side(p, s[2], s[3]) < 0) & (side(s, p[0], p[1]) * side(s, p[2], p[3]) < 0)
    ends = [_from_point(u[i], u[i + 1], v) for u, v in ((p, s), (s, p)) for i in (0, 2)]
    return np.where(cross, 0.0, np.minimum.reduce(ends))


def near_part(p: Segment, s: Segment, r: float) -> tuple[np.ndarray, np.ndarray]:
    """The stretch of p, as parts of its length, that is at most r from s; not a number where there is none.

    What is near a segment is convex, so there is one stretch: of the strip beside it and the discs about its ends.
    """
    px, py, ax, ay, bx, by = *p[:2], *s
    dx, dy, sx, sy = p[2] - px, p[3] - py, bx - ax, by - ay
    size, square = np.sqrt(sx * sx + sy * sy), dx * dx + dy * dy
    strip = []
    for at, step, lo, hi in (((px - ax) * sx / size + (py - ay) * sy / size, (dx * sx + dy * sy) / size, 0.0, size), (((px - ax) * sy - (py - ay) * sx) / size, (dx * sy - dy * sx) / size, -r, r)):
        flat, inside = step == 0, (at >= lo) & (at <= hi)
        x, y = _part(lo - at, step), _part(hi - at, step)
        strip.append([np.where(flat, np.where(inside, end, np.nan), f(x, y)) for f, end in ((np.minimum, 0.0), (np.maximum, 1.0))])
    (af, at), (bf, bt) = strip  # nulls stay, as maximum and minimum keep what is not a number
    found = [(np.maximum(np.maximum(af, bf), 0.0), np.minimum(np.minimum(at, bt), 1.0))]
    for cx, cy in ((ax, ay), (bx, by)):
        b, c = (px - cx) * dx + (py - cy) * dy, (px - cx) * (px - cx) + (py - cy) * (py - cy) - r * r
        q = b * b - square * c
        root = np.sqrt(np.where(q >= 0, q, np.nan))
        found.append((np.maximum((-b - root) / square, 0.0), np.minimum((-b + root) / square, 1.0)))
    kept = [[np.where(f <= e, x, np.nan) for x in (f, e)] for f, e in found]
    return np.fmin.reduce([f for f, _ in kept]), np.fmax.reduce([e for _, e in kept])


def near(r: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``(…, px0 … sy1, poff, plen)`` of segments at most r apart, as ``(…, distance, _lo, _hi)``: from where to where
    along its line p is that near to s, null if nowhere."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            whole = [rows.column(c).to_numpy(zero_copy_only=False) for c in (*ENDS, "poff", "plen")]
            with np.errstate(all="ignore"):
                d = distance(tuple(whole[:4]), tuple(whole[4:8]))
                ok = np.flatnonzero(d <= r)
                *ends, off, size = (x[ok] for x in whole)
                stretch = [off + x * size for x in near_part(tuple(ends[:4]), tuple(ends[4:]), r)]
            own = [c for c in rows.schema.names if c not in (*ENDS, "poff", "plen")]
            yield pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(ok)) for c in own), pa.array(d[ok]), *(pa.array(x, from_pandas=True) for x in stretch)], [*own, "distance", "_lo", "_hi"])

    return of
