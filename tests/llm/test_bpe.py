"""Word BPE against the tokenizers library."""

import hashlib
import json
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronopath.llm import bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def code(text):
    c = bpe.coder(bpe.default_path())
    pre = [p for w in c.words(text) for p in c.pretokens(w)]
    ids, size, _ = c.speculate([p for p in pre if isinstance(p, str)])
    counts = c.count_symbols([p for p in pre if isinstance(p, str)])
    assert counts.tolist() == size.tolist()
    parts = iter(np.split(ids, np.cumsum(size)[:-1]) if len(size) else [])
    out = [i for p in pre for i in (next(parts).tolist() if isinstance(p, str) else [p])]
    assert int(counts.sum()) + sum(not isinstance(p, str) for p in pre) == len(out)
    return out


HARD = ["", " ", "Don't we'll I'M 123 ab12", "<|endoftext|>a<|startoftext|> <|endoftext|", "x\x1cy \x1f", "é é ΑΣ Σ ΑΣ. İI ǅ", "naïve Straße ÀÉ", "漢字かな ﷺ 한국어", "aaaaaaa aaaa a" * 9, "​᠎ x y z", "🙂🙂👍🏽 ok", "½ ² ٣ Ⅷ", "---- ===== ....!!!", "́a ͅ"]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(library, text):
    assert code(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text("abcde '<|>\n\tÉéß1Σ", max_size=60) | st.text("etaoinshr", max_size=30))
def test_any_text(text):
    from tokenizers import Tokenizer

    lib = test_any_text.lib = getattr(test_any_text, "lib", None) or Tokenizer.from_file(bpe.default_path())
    assert code(text) == lib.encode(text, add_special_tokens=False).ids


def test_compatibility_is_that_of_merging():
    c = bpe.coder(bpe.default_path())
    rng = np.random.default_rng(2)
    ids = np.array([i for i, t in c.text.items() if t not in c.specials and not t.endswith("</w>") and c.sound()[i]])
    ends = np.array([i for i, t in c.text.items() if t.endswith("</w>") and c.sound()[i]])
    a, b = rng.choice(ids, 3000), rng.choice(ends, 3000)
    got = c.compatible(a, b)
    want = c.exact([c.text[x] + c.text[y][:-4] for x, y in zip(a, b, strict=True)])
    assert got.tolist() == [w.tolist() == [x, y] for w, x, y in zip(want, a, b, strict=True)]


def test_queries_on_a_table(spark, library):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(90, None), (None, "b c"), (91, "word " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens")
    got = sorted(bpe.encode_decode(df, with_ids=True).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    counted = sorted(bpe.count_tokens(df, limit=20).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    for r, c, (i, t) in zip(got, counted, sorted(rows, key=lambda r: (r[0] is None, r[0])), strict=True):
        e = library.encode(t or "", add_special_tokens=False)
        d = library.decode(e.ids, skip_special_tokens=False)
        assert r.doc_id == i and r.ids == e.ids and r.decoded == d and r.n_tokens == len(e.ids) == c.n_tokens
        assert r.ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(d.encode()).hexdigest()
        assert c.over_limit == (len(e.ids) > 20) and c.n_bytes == len((t or "").encode())
    assert bpe.encode_decode(df.limit(0)).count() == bpe.count_tokens(df.limit(0)).count() == 0


def test_real_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in bpe.op6_bpe_encode_decode(spark, "/root/testdata/sf0.001").collect()}
    counted = {r.doc_id: r.n_tokens for r in bpe.op7_token_counts(spark, "/root/testdata/sf0.001").collect()}
    for r in docs:
        e = library.encode(r.text, add_special_tokens=False)
        assert got[r.doc_id].n_tokens == len(e.ids) == counted[r.doc_id]
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()


def test_very_long_words(library):
    """Five megabytes without a blank: time grows in proportion, ids are the library's where that can be asked."""
    rng = np.random.default_rng(6)
    c = bpe.coder(bpe.default_path())
    some = "".join(rng.choice(list("etaoinshrdlu"), 40_000))
    assert code(some) == library.encode(some, add_special_tokens=False).ids
    for word in ("".join(rng.choice(list("etaoinshrdlucmfwyp"), 5_000_000)), "a" * 5_000_000, "漢字" * 300_000):
        began = time.process_time()
        pre = c.pretokens(word)
        ids, size, _ = c.speculate(pre)
        assert int(c.count_symbols(pre).sum()) == len(ids) == int(size.sum())
        assert "".join([c.text[i] for i in ids.tolist()]).replace("</w>", "") == "".join(pre)
        assert time.process_time() - began < 90


def test_memo_keeps_its_bytes():
    memo = bpe.Memo(limit=10_000)
    for k in range(50):
        words = {f"w{i}" for i in range(k * 5, k * 5 + 20)}
        new = memo.missing(words)
        memo.put({w: w for w in new}, sum(map(len, new)))
        assert all(memo.young[w] == w for w in words) and len(memo.young) + len(memo.old) < 120


def test_other_files_are_refused(tmp_path):
    spec = json.load(open(bpe.default_path(), encoding="utf-8"))
    for key, value in (("normalizer", None), ("pre_tokenizer", {"type": "Whitespace"})):
        path = tmp_path / f"{key}.json"
        path.write_text(json.dumps(spec | {key: value}))
        with pytest.raises(ValueError, match=key):
            bpe.WordBPE(str(path))
