"""Fingerprints against sets of paragraphs."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronopath.llm import fingerprints as fp


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, (1 << 64) - 1), max_size=60), st.sets(st.integers(0, (1 << 64) - 1), max_size=60), st.sets(st.integers(0, (1 << 64) - 1), max_size=60)), max_size=5))
def test_likeness_is_jaccard(groups):
    a = [np.array(sorted(x | c), np.uint64) for x, _, c in groups]
    b = [np.array(sorted(y | c), np.uint64) for _, y, c in groups]
    want = [len({*p.tolist()} & {*q.tolist()}) / len({*p.tolist()} | {*q.tolist()}) if len(p) + len(q) else 1.0 for p, q in zip(a, b, strict=True)]
    (x, lx), (y, ly) = fp.sketches(a), fp.sketches(b)
    assert fp.likeness(x, y, (lx, ly)).tolist() == pytest.approx(want)
    assert [t.tolist() for t in lx] == [p.tolist() for p in a]
    assert fp.likeness(x, y).tolist() == pytest.approx(want)
    assert [fp.likeness_of(fp.serialize(p), fp.serialize(q)) for p, q in zip(x, y, strict=True)] == pytest.approx(want)
    assert [sorted(fp.listed(t).tolist()) for t in x] == [p.tolist() for p in a]


def test_peeling_recovers_what_differs_from_serialized_tables():
    """Few differences between large sets peel at any folding that has room for them; many need the whole tables."""
    rng = np.random.default_rng(0)
    common, x, y, z = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (500, 7, 4, 3000))
    a, b, c = (fp.parse(fp.serialize(fp.sketches([np.concatenate([common, w])])[0][0])) for w in (x, y, z))
    for cells in (36, 72, a[0].shape[1]):
        row, key, sign, whole = fp.peel(*(p - q for p, q in zip(fp.fold(a, cells), fp.fold(b, cells), strict=True)))
        assert whole[0] and sorted(key[sign > 0].tolist()) == x.tolist() and sorted(key[sign < 0].tolist()) == y.tolist()
        assert all((p == q).all() for p, q in zip(fp.fold(a, cells), fp.tables([np.concatenate([common, x])], cells), strict=True))
    assert fp.likeness([a], [c])[0] == pytest.approx(500 / 3507)


def check(spark, rows, df):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    got = sorted(fp.fingerprints(df).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.n_chars))
    assert len(got) == len(order)
    sets = lambda t: {*fp.paragraphs(t)}
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want, by_text = [], {}
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(jac(sets(t), sets(e)), 9), round(jac(sets(t), sets(n)), 9)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got], key=key) == sorted(want, key=key)
    unique = [r for r in got if sum(i == r.doc_id for i, _ in rows) == 1 and r.doc_id is not None]
    for r, after in zip(unique, unique[1:], strict=False):
        assert fp.likeness_of(r.fingerprint, r.edited_fingerprint) == r.near_edited
        if len(unique) == len(got):
            assert fp.likeness_of(r.fingerprint, after.fingerprint) == r.near_next
    for r in got:
        t = next((x or "" for i, x in rows if i == r.doc_id and len(x or "") == r.n_chars), "")
        if r.doc_id is not None and sum(i == r.doc_id for i, _ in rows) == 1:
            assert by_text.setdefault(t, r.fingerprint) == r.fingerprint


def test_hard_rows(spark):
    rows = [(5, "One. Two.\nThree."), (9, None), (-3, ""), (7, "One. Two.\nThree."), (1 << 40, "x" * 5000 + ". " + "y. " * 3000), (8, "Ünï cödé! 🙂 next?"), (None, "no id"), (None, "also none"), (5, "again the same id"), (6, "\n\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as bucket", "2 as ghost").repartition(4)
    check(spark, rows, df)
    check(spark, rows[:1], spark.createDataFrame(rows[:1], "doc_id long, text string"))
    assert fp.fingerprints(df.limit(0)).count() == 0


def test_real_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check(spark, [tuple(r) for r in df.collect()], df)
