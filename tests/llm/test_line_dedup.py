"""Line dedup against a walk over all lines, after insertions and deletions alike."""

import hashlib
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopath.llm.common import shared_dir
from chronopath.llm.cuckoo import Cuckoo
from chronopath.llm.line_dedup import LineIndex

SCHEMA = "doc_id long, text string, n_lines string, source string"
A, B, C = "A line that is long enough", "une ligne éééééééééé assez", "x" * 19
UPPER = "A" + "É" * 25  # É stays what it is


def brute(docs, min_docs=3, min_chars=20):
    def key(line):
        k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
        return k if len(k) >= min_chars else None

    held = {}
    for i, t in {(i, t or "") for i, t in docs}:
        for k in {key(x) for x in t.split("\n")} - {None}:
            held.setdefault(k, []).append(i)
    top = {k: max(i for i in v if i is not None) for k, v in held.items() if len(v) >= min_docs and any(i is not None for i in v)}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if (k := key(x)) not in top or i == top[k]]
        text = "\n".join(kept)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256(text.encode()).hexdigest(), text))
    return sorted(out, key=str)


def got(index, spark, docs):
    df = spark.createDataFrame([(i, t, "clash", "s") for i, t in docs], SCHEMA).repartition(3)
    out, _ = index.apply(df, keep_text=True)
    assert out.columns == ["doc_id", "source", "n_lines", "n_dropped", "kept_sha256", "kept"]
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256, r.kept) for r in out.collect()), key=str)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "clash", "s") for i, t in docs], SCHEMA)


@pytest.fixture
def index(spark):
    return LineIndex(spark, f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}")


HARD = [
    (1, f"{A}\nshort\n{B}"), (2, f"  {A.upper()}\t\n{B}\n{A}"), (3, f"{A}\r\n{C}"), (4, f"\x0b{A}\x0c\n\n{C}"), (5, C), (6, None), (7, ""), (8, f"{UPPER}\n{UPPER.lower()}"), (9, UPPER), (10, UPPER), (11, f" {A}\n{A}\x1c"),
    (None, f"{B}\nonly here and nowhere else"), (None, f"{B}\nonly here and nowhere else"), (None, A), (12, f"{B}\n{B}"), (12, f"{B}\n{B}"), (12, "another text under one doc_id"), (-5, f"{A}\n" * 4), (13, "\n" * 50 + "y" * 100_000), (14, "Y" * 100_000), (15, "y" * 100_000 + " "),
]


def test_hard_rows(spark, index):
    index.insert(frame(spark, HARD))
    assert got(index, spark, HARD) == brute(HARD)


def test_only_documents_without_id_hold_a_line(spark, index):
    docs = [(None, f"{A}\n{x}") for x in "abcd"] + [(1, B)]
    index.insert(frame(spark, docs))
    assert got(index, spark, docs) == brute(docs)  # no largest doc_id: all stay


def test_insert_and_delete_are_undone(spark, index):
    rng = np.random.default_rng(3)
    pool = [f"a line of the pool with the number {i}" for i in range(60)]
    docs = [(i, "\n".join(rng.choice(pool, rng.integers(1, 8)))) for i in range(90)]
    first, second = docs[:50], docs[50:]
    index.insert(frame(spark, first))
    before, at = got(index, spark, first), {(r.k1, r.k2): (r.n, r.top) for r in index.counts().collect()}
    assert before == brute(first)
    index.insert(frame(spark, second + first[:5]))  # five are there already
    assert got(index, spark, docs) == brute(docs)
    index.delete(spark.createDataFrame([(i,) for i, _ in second] + [(10**9,)], "doc_id long"))
    assert {(r.k1, r.k2): (r.n, r.top) for r in index.counts().collect()} == at
    assert got(index, spark, first) == before
    # The filters hold the keys that three documents hold, and no others.
    active = index._active().select(index._shard(), "k1", "k2").collect()
    filters = {r.shard: Cuckoo.of(r.filter) for r in spark.read.parquet(index.s["filters"]).collect()}
    assert sum(map(len, filters.values())) == len(active)
    assert all(filters[r.shard].has(np.array([[r.k1, r.k2]]))[0] for r in active)
    again = LineIndex.open(spark, index.folder)
    again.insert(frame(spark, second))  # and in once more
    assert got(again, spark, docs) == brute(docs)
    again.delete(spark.createDataFrame([(i,) for i in range(0, 90, 2)], "doc_id long"))
    left = [d for d in docs if d[0] % 2]
    assert got(again, spark, left) == brute(left)


def test_a_line_of_all_documents_is_split(spark, index):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit(A + "\n"), F.lit("the line with number "), F.col("id").cast("string"), F.lit("0" * 20)).alias("text"))
    index.insert(docs)
    out, _ = index.apply(docs)
    assert out.agg(F.sum("n_dropped")).first()[0] == 3999
    rows = index.refs().count()
    assert rows == 4000 and index.counts().count() == 4001


def test_many_insertions_merge_runs(spark, index):
    docs = [(i, A) for i in range(10)]
    for d in docs:
        index.insert(frame(spark, [d]))
    assert len(index.s["counts"]) < 9 and got(index, spark, docs) == brute(docs)


def test_empty_table(spark, index):
    index.insert(frame(spark, []))
    assert got(index, spark, []) == []


def test_filter_takes_and_gives_back():
    keys = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, (30_000, 2), dtype=np.int64)
    f = Cuckoo.empty(20_000)
    assert f.insert(keys[:20_000]) and f.has(keys[:20_000]).all() and f.has(keys[20_000:]).mean() < 0.002
    assert f.delete(keys[:10_000]).all() and len(f) == 10_000 and f.has(keys[10_000:20_000]).all()
    full = f.table.copy()
    assert not f.insert(np.repeat(keys[:1], 9, axis=0)) and (f.table == full).all()  # eight of one key at most
