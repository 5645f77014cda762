"""The corpus pipeline stage by stage against brute force, and its entry in the query list."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline as cp
from chronopath.llm import bpe
from chronopath.llm.common import materialize
from test_pairs import brute_sets, smallest
from test_suffix import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), f"test-{name}")[0])
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "mixing", "bpe"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_near_duplicates_against_brute_force(stages):
    before, after = rows(stages[1]), rows(stages[2])
    pairs = [(i, r.text) for i, r in before.items()]
    comp = smallest(list(before), brute_sets(pairs, width=5, num=80)[1])
    assert set(after) == {i for i, c in comp.items() if i == c}


def test_repeats_against_brute_force(stages):
    before, after = rows(stages[2]), rows(stages[3])
    for (i, r), (n, gone, _, sha) in zip(before.items(), brute([r.text for r in before.values()]), strict=True):
        if i in after:
            assert after[i].n_chars == len(after[i].text) and (gone > 0 or after[i].text == r.text)
            if "�" not in after[i].text and len(after[i].text.encode()) == n - gone:
                assert hashlib.sha256(after[i].text.encode()).hexdigest() == sha
        else:
            assert gone > 0


def test_mixing_draws_whole_documents(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert 0 < len(after) < len(before) and all(before[i] == r for i, r in after.items())


def test_tokens_are_the_library_ones(stages):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    text = {i: r.text for i, r in rows(stages[4]).items()}
    for i, r in rows(stages[5]).items():
        ids = lib.encode(text[i], add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_run_is_the_stages_in_a_row(spark, stages):
    got = {r.doc_id: r.ids_sha256 for r in cp.run(spark, SF).collect()}
    assert got == {i: r.ids_sha256 for i, r in rows(stages[5]).items()}


HARD = [
    (1, None, "en", "a", None), (2, "", None, "a", 0), (None, "some text here and some more", "en", None, 14), (3, "same words again and again", "en", "b", 26), (4, "same words again and again", "en", "b", 26),
    (5, "x" * 200_000, "de", "b", 200_000), (None, "some text here and some more", "en", "b", 14), (6, "one text of a shared id", "en", "b", 1), (6, "another text of the shared id", "en", "b", 1), (6, "one text of a shared id", "en", "b", 1),
    (7, "same words again and again", "en", "b", 26), (8, None, "en", "a", None), (8, None, "en", "a", None),
]
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_hard_rows(spark, tmp_path):
    df = spark.createDataFrame(HARD, KIND).selectExpr("*", "1 as _row", "'x' as topic", "2 as k1").drop("_row")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for some in (df, df.limit(0)):
        cur, sizes = some, []
        for name, stage in cp.STAGES:
            cur, _ = materialize(stage(spark, cur, str(tmp_path)), f"hard-{name}")
            assert name == "bpe" or cur.columns == df.columns
            sizes.append(cur.count())
        assert sizes[0] == (13 if some is df else 0) and sizes[-1] <= sizes[2] <= sizes[1]


def test_toxic_rows_go_whatever_their_id(spark, tmp_path):
    rows = [(i, "you are a vile worthless idiot and scum" if i % 4 == 0 else f"a calm report about trains and rivers {i}", "en", "a", 1) for i in range(400)]
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    more = [(None, rows[0][1], "en", "a", 1), (None, rows[1][1], "en", "a", 1), (3, rows[0][1], "en", "a", 1)]
    left = [(r.doc_id, r.text) for r in cp.toxicity(spark, spark.createDataFrame(rows + more, KIND), str(tmp_path)).collect()]
    assert sorted(left, key=str) == sorted([(r[0], r[1]) for r in rows + more if "vile" not in r[1]], key=str)


def test_near_duplicates_of_hard_ids(spark):
    got = sorted(((r.doc_id, r.text) for r in cp.near_duplicates(spark, spark.createDataFrame(HARD, KIND), SF).collect()), key=str)
    assert got == sorted({(1, None), (2, ""), (None, "some text here and some more"), (3, "same words again and again"), (5, "x" * 200_000), (6, "one text of a shared id"), (6, "another text of the shared id"), (8, None)}, key=str)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
