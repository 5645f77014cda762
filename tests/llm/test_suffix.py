"""Suffix dedup and the induced sort against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronopath.llm import suffix_dedup
from chronopath.llm.induced import suffix_order


def brute_order(d, cap):
    sa = sorted(range(len(d)), key=lambda i: d[i:])
    lcp = [0] * bool(d)
    for a, b in zip(sa, sa[1:], strict=False):
        k = 0
        while a + k < len(d) and b + k < len(d) and d[a + k] == d[b + k] and k < cap:
            k += 1
        lcp.append(k)
    return sa, lcp


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60) | st.text("ab", max_size=80).map(str.encode), st.integers(1, 3), st.sampled_from([4, 30, 255]), st.sampled_from([0, 64, 1 << 20]))
def test_order_and_prefixes(d, times, cap, memory):
    d = d * times
    got = sorted(suffix_order(d, cap, memory), key=lambda g: d[g[0][0]])
    sa = [int(x) for p, _ in got for x in p]
    lcp = [int(x) for _, c in got for x in np.r_[0, c[1:]]]
    want, want_lcp = brute_order(d, cap)
    assert [d[i : i + cap] for i in sa] == [d[i : i + cap] for i in want] and sorted(sa) == list(range(len(d))) and lcp == want_lcp


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + 200] for r in raw for i in range(len(r) - 199))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def compare(spark, texts, frame=None):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as n_spans", "2 as k1", "3 as part")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_spans(df).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeéß "), 6))
    base = [" ".join(word() for _ in range(60)) for _ in range(5)]
    texts = []
    for i in range(120):
        t = "".join(word() for _ in range(int(rng.integers(1, 120))))
        k = int(rng.integers(0, 5))
        if i % 2:
            b = base[k]
            a = int(rng.integers(0, 100))
            t = t[: int(rng.integers(0, len(t)))] + b[a : a + int(rng.integers(150, 300))] + t
        texts.append(t)
    texts += [texts[0], texts[1] + "x", "a" * 199, "a" * 199, "b" * 200, "b" * 200, "c" * 201, "-" * 1000, "ab" * 300, None, "", base[0] * 3]
    compare(spark, texts)
    monkeypatch.setattr(suffix_dedup, "PIECE", suffix_dedup.PIECE)
    assert suffix_dedup.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pieces_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    texts = [b"x" * n for n in (0, 199, 200, 999, 1000, 1001, 5000)]
    seen = Counter()
    for buf, who, starts, ends, off in suffix_dedup.pieces(texts):
        assert len(buf) <= 1000
        for w, s, e, o in zip(who, starts, ends, off, strict=True):
            seen.update((int(w), int(o) + i) for i in range(e - s - 199))
    assert set(seen.values()) == {1} and len(seen) == sum(max(0, len(t) - 199) for t in texts)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_real_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in docs], brute([r.text for r in docs]), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op2_suffix_array_dedup(spark, f"/root/testdata/{sf}").collect()}
    assert got == want


@pytest.mark.parametrize("size", [60, 130, 199, 215])
def test_hot_anchor_is_split(spark, size):
    """A passage with different surroundings: no anchor leaves more than a shard to be sorted, and results stay exact."""
    rng = np.random.default_rng(size)
    passage = bytes(rng.integers(97, 123, size, np.uint8)).decode()
    around = rng.integers(97, 123, (6000, 2, 250), np.uint8)
    texts = [bytes(a).decode() + passage + bytes(b).decode() for a, b in around]
    docs = pa.RecordBatch.from_pydict({"k1": pa.array(range(6000), pa.int64()), "k2": pa.array(range(6000), pa.int64()), "text": texts})
    held: Counter = Counter()
    for b in suffix_dedup._statuses(1)(b.drop_columns("bucket") for b in suffix_dedup._anchors(1)(iter([docs]))):
        for kind, h, n in zip(*(b.column(c).to_pylist() for c in ("kind", "h", "n")), strict=True):
            for a, k in zip(np.frombuffer(h, np.uint64).tolist(), np.frombuffer(n, np.uint32).tolist(), strict=True):
                held[kind, a] += k + 200
    assert max((v for (kind, _), v in held.items() if kind == 1), default=0) <= suffix_dedup.SHARD_BYTES
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lambda **k: sorted(map(tuple, suffix_dedup.repeated_spans(df, **k).select("doc_id", "n_removed", "kept_sha256").collect()))
    assert rows() == rows(hot=1 << 60)  # all sorted


def test_windows_one_by_one_against_brute_force(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdeé "), 6))
    base = [" ".join(word() for _ in range(60)) for _ in range(3)]
    texts = ["".join(word() for _ in range(int(rng.integers(1, 40)))) + base[i % 3][int(rng.integers(0, 60)) :][: int(rng.integers(100, 350))] + "".join(word() for _ in range(20)) for i in range(60)]
    texts += [texts[0], texts[1] + "x", "-" * 1000, "ab" * 300, None, base[0] * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_spans(df, hot=0).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_copies_of_one_text_are_told_once(spark):
    """Many copies of a text give no more rows of positions than two of them, in one part or several."""
    from chronopath.llm.suffix_dedup import _A, _S, _anchors, _statuses

    import numpy as np

    def told(n):
        text = "".join(chr(97 + i * i % 23) for i in range(3000)) + "tail" * 20
        docs = spark.range(n).selectExpr("xxhash64('a') as k1", "xxhash64('b') as k2", f"'{text}' as text").repartition(4)
        blob = lambda names: ", ".join(f"{c} binary" for c in names)
        packed = docs.mapInArrow(_anchors(4), f"bucket int, {blob(_A)}").repartition(4, "bucket").mapInArrow(_statuses(4), f"part int, kind int, {blob(_S)}, bytes long")
        return sum(len(np.frombuffer(r.pos, np.uint32)) for r in packed.where("kind = 0").collect())

    assert 0 < told(20_000) <= told(8) <= 2 * told(20_000)


def test_hot_text_and_its_parts(spark):
    hot = "x1y2" * 100 + "the middle of the text " * 20
    texts = [hot] * 300 + [hot[100:700], "short", "short", hot[:199], None, ""]
    compare(spark, texts)
