"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

A text's paragraphs (lines, cut again after sentence ends) are hashed to digests; each digest is added to one cell in
each third of a table, with its checksum. A text's table has the least size at which it peels alone, so it lists all its
digests; sizes double, and a table folds to any smaller size. Two tables are folded to the smaller one's size and
subtracted, and the difference peels: a cell that holds one digest gives it up, and it is taken out of its other cells.
What peels on either side tells how many paragraphs each text has alone, and with the set sizes the Jaccard likeness.
Where the difference doesn't peel wholly, the larger tables are taken: each is listed and the lists are compared. So the
likeness comes from the two fingerprints and from nothing else.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopath.llm.common import shuffle_parts, small_batches

CELLS = 36
U = np.uint64
_END = re.compile(r"(?<=[.!?])\s+|[\r\n]+")


def paragraphs(text: str) -> list[str]:
    return [s for p in _END.split(text) if (s := p.strip())]


def digests(text: str) -> np.ndarray:
    """Sorted distinct 64-bit paragraph digests."""
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(p) for p in paragraphs(text)), U))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ U(salt * 0x9E3779B97F4A7C15 % (1 << 64))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _check(key: np.ndarray) -> np.ndarray:
    return _mix(key, 5) & U(0xFFFFFFFF)


def _cells(key: np.ndarray, cells: int) -> list[np.ndarray]:
    third = cells // 3
    return [(_mix(key, 11 + i) % U(third)).astype(np.int64) + i * third for i in range(3)]


Table = tuple[np.ndarray, np.ndarray, np.ndarray]


def tables(sets: list[np.ndarray], cells: int) -> Table:
    """(counts, digest sums, checksum sums), one row of cells for each set; sums are modulo 2^64."""
    n = len(sets)
    key = np.concatenate(sets) if n else np.empty(0, U)
    row = np.repeat(np.arange(n), [len(s) for s in sets]) if n else np.empty(0, np.int64)
    count, keys, check = np.zeros(n * cells, np.int64), np.zeros(n * cells, U), np.zeros(n * cells, U)
    c = _check(key)
    for at in _cells(key, cells):
        np.add.at(count, row * cells + at, 1)
        np.add.at(keys, row * cells + at, key)
        np.add.at(check, row * cells + at, c)
    return count.reshape(n, cells), keys.reshape(n, cells), check.reshape(n, cells)


def fold(table: Table, cells: int) -> Table:
    """Tables as they would be with fewer cells; their number must divide the present one."""
    return tuple(x.reshape(len(x), 3, -1, cells // 3).sum(2, dtype=x.dtype).reshape(len(x), cells) for x in table)


def peel(count: np.ndarray, keys: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Peel differences of tables, all rows together: (rows, digests, signs) that came out, and which rows are empty now."""
    n, cells = count.shape
    count, keys, check = count.copy().ravel(), keys.copy().ravel(), check.copy().ravel()
    out: list[list[np.ndarray]] = [[], [], []]
    look = np.arange(n * cells)
    while len(look):
        one = look[np.abs(count[look]) == 1]
        sign = count[one]
        key = np.where(sign > 0, keys[one], U(0) - keys[one])
        sure = _check(key) == np.where(sign > 0, check[one], U(0) - check[one])
        one, sign, key = one[sure], sign[sure], key[sure]
        row = one // cells
        # One digest may stand alone in several cells of a row; what a collision hides comes out in the next round.
        _, first = np.unique(_mix(key, 3) + row.astype(U) * U(0x9E3779B97F4A7C15), return_index=True)
        row, sign, key = row[first], sign[first], key[first]
        for to, v in zip(out, (row, key, sign), strict=True):
            to.append(v)
        touched = []
        c = _check(key)
        for at in _cells(key, cells):
            p = row * cells + at
            np.subtract.at(count, p, sign)
            np.subtract.at(keys, p, np.where(sign > 0, key, U(0) - key))
            np.subtract.at(check, p, np.where(sign > 0, c, U(0) - c))
            touched.append(p)
        look = np.unique(np.concatenate(touched)) if len(row) else np.empty(0, np.int64)
    whole = ~((count != 0) | (keys != 0) | (check != 0)).reshape(n, cells).any(1)
    row, key, sign = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
    return row, key, sign, whole


def sketches(sets: list[np.ndarray], cells: int = CELLS) -> tuple[list[Table], list[np.ndarray]]:
    """Of each set the table of the least size, ``cells`` or a doubling of it, that peels alone, and what comes out."""
    out: list = [None] * len(sets)
    lists: list = [None] * len(sets)
    size = np.full(len(sets), cells)
    n = np.array([len(s) for s in sets], np.int64)
    while (small := size < 1.25 * n).any():  # less never peels
        size[small] *= 2
    live = np.arange(len(sets))
    while len(live):
        failed = []
        for c in np.unique(size[live]).tolist():
            at = live[size[live] == c]
            t = tables([sets[i] for i in at.tolist()], c)
            row, key, _, whole = peel(*t)
            order = np.lexsort((key, row))
            keys, cut = key[order].astype(U), np.searchsorted(row[order], np.arange(len(at) + 1)).tolist()
            for k in np.flatnonzero(whole).tolist():
                out[at[k]], lists[at[k]] = tuple(x[k : k + 1] for x in t), keys[cut[k] : cut[k + 1]]
            failed.append(at[~whole])
        live = np.concatenate(failed)
        size[live] *= 2
    return out, lists


def listed(table: Table) -> np.ndarray:
    """Sorted digests of one table that peels alone."""
    return np.sort(peel(*table)[1].astype(U))


def likeness(a: list[Table], b: list[Table], lists: tuple[list, list] | None = None) -> np.ndarray:
    """Jaccard likeness of pairs of tables: their difference at the smaller size, or both listed where that doesn't peel.

    ``lists``: what the tables give when they peel alone, where that is known already.
    """
    out = np.ones(len(a))
    size = np.array([min(x[0].shape[1], y[0].shape[1]) for x, y in zip(a, b, strict=True)], np.int64)
    for c in np.unique(size).tolist():
        at = np.flatnonzero(size == c)
        x, y = ([np.concatenate(p) for p in zip(*(z[i] if z[i][0].shape[1] == c else fold(z[i], c) for i in at.tolist()), strict=True)] for z in (a, b))
        row, _, sign, whole = peel(*(p - q for p, q in zip(x, y, strict=True)))
        left, right = (np.bincount(row[sign == s].astype(np.int64), minlength=len(at)) for s in (1, -1))
        n = x[0].sum(1) // 3
        union = n + right
        out[at] = np.where(union > 0, (n - left) / np.maximum(union, 1), 1.0)
        for k in at[~whole].tolist():
            p, q = (lists[0][k], lists[1][k]) if lists else (listed(a[k]), listed(b[k]))
            both = np.concatenate([p, q])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            out[k] = common / (len(both) - common)
    return out


_CELL = np.dtype([("n", "<i4"), ("k", "<u8"), ("c", "<u8")])


def serialize(table: Table) -> str:
    """A table as text: cells of count (4 bytes), digest sum (8), checksum sum (8), little-endian, in base64."""
    cell = np.empty(table[0].shape[1], _CELL)
    cell["n"], cell["k"], cell["c"] = (x[0] for x in table)
    return base64.b64encode(cell.tobytes()).decode()


def parse(fingerprint: str) -> Table:
    cell = np.frombuffer(base64.b64decode(fingerprint), _CELL)
    return cell["n"].astype(np.int64)[None], cell["k"].copy()[None], cell["c"].copy()[None]


def likeness_of(a: str, b: str) -> float:
    """Likeness of two fingerprints."""
    return float(likeness([parse(a)], [parse(b)])[0])


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next document."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _run(cells: int):
    def rows(part: list[tuple]) -> pa.RecordBatch:
        ids = [p[0] for p in part]
        text, following = [p[1] for p in part], [p[2] for p in part]
        edited = [edit(t, f) for t, f in zip(text, following, strict=True)]
        every = list({*text, *following, *edited})
        made, lists = sketches([digests(t) for t in every], cells)
        of = {t: i for i, t in enumerate(every)}
        a, b, nxt = ([made[of[t]] for t in x] for x in (text, edited, following))
        la, lb, ln = ([lists[of[t]] for t in x] for x in (text, edited, following))
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in text], pa.int64()), "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
            "fingerprint": pa.array(list(map(serialize, a))), "edited_fingerprint": pa.array(list(map(serialize, b))), "near_edited": pa.array(likeness(a, b, (la, lb))), "near_next": pa.array(likeness(a, nxt, (la, ln))),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part, held = None, [], 0
        for b in batches:
            for bucket, ghost, i, t in zip(*(b.column(c).to_pylist() for c in ("bucket", "ghost", "doc_id", "text")), strict=True):
                if last and last[0] == bucket and not last[1]:
                    part.append((last[2], last[3], t))
                    held += len(t) + len(last[3])
                    if len(part) >= 512 or held > 1 << 23:
                        yield rows(part)
                        part, held = [], 0
                last = bucket, ghost, i, t
        if part:
            yield rows(part)

    return run


def _place(bounds: list[int]) -> str:
    """Number of the range of doc_id among sorted bounds (-1: null), in two steps of about the root of their number."""
    if not bounds:
        return "if(doc_id is null, -1, 0)"
    step = max(1, round(len(bounds) ** 0.5))
    rough = ", ".join(f"{b}L" for b in bounds[::step])
    fine = ", ".join(f"array({', '.join(f'{b}L' for b in bounds[i : i + step])})" for i in range(0, len(bounds), step))
    first = f"size(filter(array({rough}), b -> b <= doc_id))"
    return f"if(doc_id is null, -1, get(transform(array({first}), c -> if(c = 0, 0, (c - 1) * {step} + size(filter(get(array({fine}), c - 1), b -> b <= doc_id)))), 0))"


def fingerprints(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """Fingerprints of each text of ``docs(doc_id, text)`` and of its edited text, and what they tell of likeness.

    Rows ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``, one per input
    row. The next document is the one after in descending doc_id order (equal ids by text, null ids last, and after
    the last the first). A null text is empty; texts without paragraphs have the zero table, and two of them have
    likeness 1. Other columns are ignored. Documents are dealt into ranges of doc_id; each range also gets the first
    document of the range below it, so one shuffle of the texts is all.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = shuffle_parts(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = sorted({int(b) for b in src.approxQuantile("doc_id", [i / (4 * parts) for i in range(1, 4 * parts)], 0.25 / (4 * parts))})
    place = F.expr(_place(bounds))
    # One row a range: its first document goes to the range above as well, the topmost's to the lowest.
    tops = sorted((r.bucket, r.top) for r in src.select("doc_id", place.alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())
    dealt = src.withColumn("bucket", place).withColumn("ghost", F.lit(0))
    to = {b: tops[(i + 1) % len(tops)][0] for i, (b, _) in enumerate(tops)}
    for null in (False, True):
        some = [(t, to[b]) for b, t in tops if (t is None) == null]
        if some:
            at = F.col("doc_id").isNull() if null else F.col("doc_id").isin([t for t, _ in some])
            goes = F.lit(some[0][1]) if null else F.create_map(*[F.lit(v) for pair in some for v in pair])[F.col("doc_id")]
            dealt = dealt.unionByName(src.where(at).withColumn("bucket", goes).withColumn("ghost", F.lit(1)))
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "ghost", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.mapInArrow(_run(cells), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
