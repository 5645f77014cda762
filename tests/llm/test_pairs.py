"""Operators on pairs against brute force."""

from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from chronopath.llm import common, embedding_dedup, ngram_join


def smallest(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (5, 6), (6, 7), (7, 8), (8, 5), (4, 4), (20, 19), (19, 18), (18, 17), (17, 16)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = smallest({x for p in links for x in p} - {4}, [p for p in links if p[0] != p[1]])
    assert got == want
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, threshold):
    good, by = {}, defaultdict(list)
    for i, v, lab in rows:
        if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float64)
            by[lab, len(v)].append(i)
    links = []
    for ids in by.values():
        m = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
        c = m @ m.T
        links += [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(c >= threshold, 1)), strict=True)]
    return links


@pytest.mark.parametrize("size", [300])
def test_embeddings_against_brute_force(spark, size, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = [(i, [float(np.float32(x)) for x in base[i % 40] + rng.normal(size=16) * rng.choice([0.02, 0.2, 0.3])], int(i % 3)) for i in range(size)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(5)] + [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 1), (2003, rows[0][1], None), (2004, [None] * 16, 0), (2005, [1.0], 0), (2006, [], 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as rep", "'x' as mult")).toPandas().set_index("vec_id")
    links = brute_vectors(rows, 0.93)
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    comp = smallest([r[0] for r in rows], links)
    assert len(got) == len(rows)
    assert sum(got.n_links) >= 0.98 * 2 * len(links) and all(got.n_links[i] <= n[i] for i in got.index)
    assert np.mean([got.component_id[i] == comp[i] for i in got.index]) > 0.98
    assert (got.kept == (got.index == got.component_id)).all()
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embedding_blocks_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * 0.02).tolist(), 1) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    got = embedding_dedup.near_duplicates(df).toPandas()
    assert (got.n_links == 59).all() and (got.component_id == 0).all()


@pytest.mark.parametrize("dims,rows", [(16, 300), (64, 5_000), (64, 10**6), (64, 10**9), (768, 10**4), (768, 10**9)])
def test_recall_at_the_threshold(dims, rows):
    """Planted pairs at cosine 0.93, under the plan for tables of any size."""
    rng = np.random.default_rng(dims + rows)
    hashes, tables, probes = embedding_dedup.plan(rows, 1 << (dims - 1).bit_length())
    a, b = rng.normal(size=(2, 600, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.931 * a + np.sqrt(1 - 0.931**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = (embedding_dedup.bucket_keys(v, hashes, tables, probes) for v in (a, b))
    assert (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3)).mean() >= 0.98


def test_planted_pairs_in_the_real_table(spark):
    """The table's own vectors and, of each of the first 300, one at cosine 0.935 and one at 0.925: nothing else changes."""
    rng = np.random.default_rng(3)
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    more = []
    for i, v, lab in rows[:300]:
        v = np.array(v, np.float64) / np.linalg.norm(v)
        w = rng.normal(size=len(v))
        w -= (v * w).sum() * v
        w /= np.linalg.norm(w)
        more += [(10_000_000 + 2 * i + k, (c * v + np.sqrt(1 - c * c) * w).tolist(), lab) for k, c in enumerate((0.935, 0.925))]
    every = rows + more
    links = brute_vectors(every, 0.93)
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    got = embedding_dedup.near_duplicates(spark.createDataFrame(every, "vec_id long, embedding array<double>, label long")).toPandas().set_index("vec_id")
    assert all(got.n_links[i] <= n[i] for i in got.index) and got.n_links.sum() >= 0.98 * 2 * len(links) and len(links) >= 300


def test_large_buckets_count_each_pair_once(spark, monkeypatch):
    """Dense groups: pairs share small and large buckets, in several tables."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(6, 32))
    rows = [(i, (base[i % 6] + rng.normal(size=32) * 0.12).tolist(), i % 2) for i in range(500)]
    monkeypatch.setattr(embedding_dedup, "SMALL", 5)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    monkeypatch.setattr(embedding_dedup, "HOT", 3)
    rows += [(1000 + i, rows[0][1], 0) for i in range(9)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).toPandas().set_index("vec_id")
    n, links = defaultdict(int), brute_vectors(rows, 0.93)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    comp = smallest([r[0] for r in rows], links)
    assert all(got.n_links[i] <= n[i] for i in got.index) and got.n_links.sum() >= 0.995 * 2 * len(links)
    assert np.mean([got.component_id[i] == comp[i] for i in got.index]) > 0.99


def brute_sets(rows, width=3, num=90, den=100):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    links = []
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * min(len(a), len(b)) >= num * max(len(a), len(b)):
                k = len(a & b)
                if den * k >= num * (len(a) + len(b) - k):
                    links.append((rows[i][0], rows[j][0]))
    return [len(s) for s in sets], links


@pytest.mark.parametrize("group", [2, 8])
def test_jaccard_against_brute_force(spark, group, monkeypatch):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(420):
        n = int(rng.choice([1, 2, 3, 8, 12, 20, 40, 120, 400]))
        if rows and rng.random() < 0.6:
            w = (rows[int(rng.integers(len(rows)))][1] or "x").split(" ")
            for _ in range(int(rng.integers(0, max(2, len(w) // 40 + 1)))):
                w[int(rng.integers(len(w)))] = f"w{rng.integers(50)}"
            if rng.random() < 0.3:
                w = w[:-1] or w
        else:
            w = [f"w{x}" for x in rng.integers(0, 200, n)]
        rows.append((i * 3, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "Ünï X"), (5004, "Ünï x"), (5005, "ünï x"), (5006, rows[3][1].upper())]
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", group)
    monkeypatch.setattr(ngram_join, "GROUP_BLOCK", 3 * group)
    sizes, links = brute_sets(rows)
    comp = smallest([r[0] for r in rows], links)
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as sig")).toPandas().set_index("doc_id")
    assert len(got) == len(rows)
    assert {i: int(v) for i, v in got.n_shingles.items()} == dict(zip([r[0] for r in rows], sizes, strict=True))
    assert {i: int(v) for i, v in got.component_id.items()} == comp
    assert ngram_join.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_allocation_covers_every_difference():
    for lo, hi in zip(ngram_join.bands(5000), ngram_join.bands(5000)[1:], strict=False):
        ones, exact, spare = ngram_join.allocation(lo, hi - 1, 90, 100)
        need = ngram_join.max_difference(2 * (hi - 1), 90, 100) + 1
        assert need == 1 and ones == exact == 0 or 2 * ones + exact >= need + spare


def test_real_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    sizes, links = brute_sets(rows)
    got = ngram_join.op8_ngram_jaccard_join(spark, "/root/testdata/sf0.001").toPandas()
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == smallest([r[0] for r in rows], links)
    pd.testing.assert_index_equal(pd.Index(sorted(got.doc_id)), pd.Index(sorted(r[0] for r in rows)))


def test_labels_that_are_no_numbers_are_refused(spark):
    from chronopath.llm.embedding_dedup import near_duplicates

    with pytest.raises(ValueError, match="whole numbers"):
        near_duplicates(spark.createDataFrame([(1, [1.0], "a")], "vec_id long, embedding array<double>, label string"))
