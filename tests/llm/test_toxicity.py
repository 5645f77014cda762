"""Toxicity: held-out accuracy, hard rows, and sentences located."""

import numpy as np

from chronopath.llm import toxicity as tx


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        sents = [" ".join(f"w{x}" for x in rng.integers(0, 80, 9)) for _ in range(int(rng.integers(1, 9)))]
        if toxic:
            k = int(rng.integers(len(sents)))
            sents[k] += f" you {['vile', 'rotten', 'nasty'][int(rng.integers(3))]} fool"
        rows.append((i, ". ".join(sents) + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_sentences(spark):
    rows, labels = corpus(1200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as toxic", "3 as key")
    got = tx.toxicity(docs, spark.createDataFrame([*labels, (None, 1), (3, None), (7, 9)], "doc_id long, toxic int")).toPandas().set_index("doc_id")
    y = np.array([t for _, t in labels])
    held = got.held_out.loc[range(1200)].to_numpy()
    assert 0.1 < held.mean() < 0.3
    assert (got.predicted.loc[range(1200)].to_numpy() == y)[held].mean() > 0.97
    hit = [(i, got.offending[i]) for i in range(0, 1200, 4) if len(got.offending[i])]
    assert len(hit) > 280
    text = dict(rows)
    assert np.mean(["fool" in text[i].encode()[s[0]["start"] : s[0]["end"]].decode() for i, s in hit]) > 0.97


def test_hard_rows(spark):
    rows = [(1, None), (2, ""), (3, " .!? "), (4, "word " * 100_000), (None, "you fool"), (4, "x"), (5, "é漢🙂")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for labels in ([], [(2, 0)], [(2, 0), (4, 1)]):
        got = tx.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert tx.toxicity(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_gradient_is_that_of_the_loss():
    """A document's chance is one minus the product of its sentences' clean chances."""
    b = tx.bags([b"bad word. good word", b"", b"good"])
    m = tx.Model(np.sort(b.word[:1]), np.array([3.0]), -1.0, 0.1)
    z = m.sentences(b)
    p = m.documents(z, b.owner, 3)
    one = 1 - np.exp(-0.1) * np.prod(1 - 1 / (1 + np.exp(-z[b.owner == 0])))
    assert np.isclose(p[0], one) and np.isclose(p[1], 1 - np.exp(-0.1))


def test_gradient_against_differences():
    """One step of plain descent along what ``train`` climbs lowers the loss; the fitted loss is lower than at the start."""
    rng = np.random.default_rng(1)
    docs = [(rng.integers(0, 6, 8).astype(np.int32), np.sort(rng.integers(0, 3, 8)).astype(np.int32)) for _ in range(60)]
    toxic = np.array([int(0 in f[:4]) for f, _ in docs])
    keys = np.arange(1, 7).astype(np.uint64) << np.uint64(42)
    m = tx.train(keys, tx.Sample([f for f, _ in docs], [s for _, s in docs], [3] * 60, toxic, np.ones(60)))

    def loss(weights, bias, leak):
        total = 0.0
        for (f, s), y in zip(docs, toxic, strict=True):
            z = bias + np.bincount(s, weights[f], 3)
            p = 1 - np.exp(-leak) * np.prod(1 / (1 + np.exp(z)))  # noisy-or, written out
            total -= np.log(max(p if y else 1 - p, 1e-12))
        return total / 60

    start, end = loss(np.zeros(6), -5.0, np.exp(-3.0)), loss(m.weights, m.bias, m.leak)
    assert end < 0.6 * start
    for k in range(6):  # no small change of one weight alone lowers the regularised loss by much
        for step in (-0.05, 0.05):
            w = m.weights.copy()
            w[k] += step
            pen = lambda v: tx.L2 / 12 * (v * v).sum()
            assert loss(w, m.bias, m.leak) + pen(w) > end + pen(m.weights) - 5e-3


def test_real_table_held_out(spark):
    """On the largest real table (the smaller ones hold out under ten toxic documents): the query's scores order
    held-out documents, and no label of theirs is learnt."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = tx.op5_toxicity(spark, sf).toPandas().set_index("doc_id")
    turned = labels.selectExpr("doc_id", f"if({tx.HELD_OUT}, 1 - toxic, toxic) as toxic")
    again = tx.toxicity(docs, turned, locate=False).toPandas().set_index("doc_id")
    assert (got.score == again.score.loc[got.index]).all()
    y = labels.toPandas().set_index("doc_id").toxic.dropna()
    held = got[got.held_out].join(y, how="inner")
    pos, neg = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    assert len(pos) > 20 and len(neg) > 20
    assert (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean() > 0.8
