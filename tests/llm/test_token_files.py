"""Token-id files: exact round trips, and ids of the tokenizers library."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronopath.llm import token_files as tf


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60000) | st.just(0) | st.integers(0, 3) | st.integers(0, (1 << 64) - 1), max_size=700), st.sampled_from([1, 7, 64, 1024]))
def test_round_trip(ids, block):
    a = np.array(ids, np.uint64)
    words, offsets = tf.encode_words(a, block)
    assert np.array_equal(tf.decode_words(words, offsets, len(a), block), a)


def test_long_runs_take_few_words():
    assert len(tf.encode_words(np.zeros(2400, np.uint64), 2400)[0]) == 10
    x = np.random.default_rng(0).integers(0, 32768, 100_000).astype(np.uint64)
    words, offsets = tf.encode_words(x)
    assert len(words) < 27_000 and np.array_equal(tf.decode_words(words, offsets, len(x)), x)


def test_files_hold_the_library_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    base = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = [*base, (100_000, None), (100_001, ""), (100_002, "a<|endoftext|>b"), (100_003, "漢字 Ω  \n\n x  "), (100_004, "   x\t\ty  "), (100_005, "tail   "), (100_006, "I'll DON'T we've 123"), (None, "null id"), (100_001, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as frame").repartition(5)
    got = sorted(tf.read_token_files(tf.write_token_files(df)[0]).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tf.read_token_files(tf.write_token_files(df.limit(0))[0]).count() == 0


def test_two_fields_of_thirty_bits():
    """Ids of 20 to 30 bits travel two a word."""
    ids = np.random.default_rng(4).integers(1 << 21, 1 << 30, 1000).astype(np.uint64)
    words, offsets = tf.encode_words(ids)
    assert len(words) == 500 and (tf.decode_words(words, offsets, 1000) == ids).all()
    mixed = np.concatenate([ids[:7], np.arange(50), np.zeros(300), ids[7:9], [1 << 59], [(1 << 63) + 5]]).astype(np.uint64)
    words, offsets = tf.encode_words(mixed)
    assert (tf.decode_words(words, offsets, len(mixed)) == mixed).all()


def test_files_that_disagree_are_refused(tmp_path):
    import json

    import public_tokenizers

    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec | {"pre_tokenizer": {"type": "Whitespace"}}))
    with pytest.raises(ValueError, match="another way"):
        tf.byte_coder(str(other), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    with pytest.raises(ValueError, match="not one vocabulary"):
        tf.byte_coder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
