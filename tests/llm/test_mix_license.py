"""Mixing against its margins; licence scans against texts with known licences."""

import numpy as np
import pytest

from chronopath.llm import licenses as lic
from chronopath.llm import mixing


def test_raked_margins_and_calibration():
    rng = np.random.default_rng(4)
    at = [rng.integers(0, k, 300) for k in (5, 4, 3)]
    tokens = rng.integers(1, 1000, 300).astype(float)
    want = [np.full(5, 0.2), np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.25, 0.25])]
    share = mixing.rake(at, tokens, want)
    for a, w in zip(at, want, strict=True):
        assert np.allclose(np.bincount(a, share, len(w)), w, atol=1e-9)
    weight = share / (tokens / tokens.sum())
    for part in (0.05, 0.5, 0.99):
        p = mixing.calibrate(weight, tokens, part)
        assert 0 <= p.min() and p.max() <= 1 and np.isclose((p * tokens).sum(), part * tokens.sum())


def test_mixing_on_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumnsRenamed({}).selectExpr("*", "1 as topic", "2 as weight")
    got = mixing.mix_to_targets(docs, {"lang": {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}}).toPandas()
    assert len(got) == 1000 and got.probability.between(0, 1).all()
    assert np.isclose((got.n_tokens * got.probability).sum(), 0.5 * got.n_tokens.sum())
    mass = (got.n_tokens * got.weight).groupby(got.lang).sum() / got.n_tokens.sum()
    assert mass["en"] == pytest.approx(0.4, abs=1e-3) and mass["es"] == pytest.approx(0.1, abs=1e-3)
    kept = got[got.selected].n_tokens.sum() / got.n_tokens.sum()
    assert 0.4 < kept < 0.6
    again = mixing.mix_to_targets(docs, {"lang": {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}}).toPandas()
    assert (again.sort_values("doc_id").selected.to_numpy() == got.sort_values("doc_id").selected.to_numpy()).all()


def test_mixing_hard_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "some words here", None, "a"), (None, "more words", "en", None), (3, "some words here", None, "a"), (4, "x " * 50_000, "de", "b")]
    got = mixing.mix_to_targets(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == 6 and all(r.probability is not None and r.selected is not None for r in got)
    assert mixing.mix_to_targets(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_topics_of_a_rare_language(spark):
    """The rare language has the ids that a sample of least hash takes last; its two vocabularies are two topics."""
    ids = [r.id for r in spark.range(4024).selectExpr("id", "xxhash64(id) as h").orderBy("h").collect()]
    words = [["uno", "due", "tre", "quattro"], ["alpha", "beta", "gamma", "delta"]]
    rows = [(d, f"the word {i % 50} and more", "en", "a") for i, d in enumerate(ids[:4000])] + [(d, " ".join(words[i % 2][: 2 + i % 3]), "xx", "a") for i, d in enumerate(ids[4000:])]
    got = mixing.mix_to_targets(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), topics=2)
    topic = {r.doc_id: r.topic for r in got.where("lang = 'xx'").collect()}
    halves = [{topic[d] for d in ids[4000 + k :: 2]} for k in (0, 1)]
    assert sorted(map(sorted, halves)) == [["t0"], ["t1"]]


def test_topics_are_those_of_all_rows(spark):
    """Against k-means in memory over every row, however the rows are dealt."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source", "lang")
    kind = "doc_id long, source string, lang string, n_tokens long, x binary"
    held = docs.mapInArrow(mixing._profiled, kind).persist()
    got = mixing.fit_topics(held, 3)
    again = mixing.fit_topics(held.repartition(5, "doc_id"), 3)
    rows = {}
    for r in held.orderBy("doc_id").collect():
        rows.setdefault(r.lang, []).append((r.doc_id, np.frombuffer(bytes(r.x), np.uint16)))
    assert set(got) == set(rows) == set(again)
    for lang, v in rows.items():
        x = np.stack([a for _, a in v if a.any()]).astype(np.float64)
        c = mixing._scaled(x[0])[None]
        for _ in range(2):
            like = (x @ c.T.astype(float)).max(1)
            c = np.r_[c, mixing._scaled(min(x[like == like.min()].astype(np.uint16), key=lambda a: a.tobytes()).astype(float))[None]]
        for _ in range(mixing.ROUNDS):
            own = (x @ c.T.astype(float)).argmax(1)
            c = np.stack([mixing._scaled(x[own == k].sum(0)) if (own == k).any() else c[k] for k in range(3)])
        c = c[np.argsort(-np.bincount((x @ c.T.astype(float)).argmax(1), minlength=3), kind="stable")]
        assert (got[lang] == c).all() and (again[lang] == c).all()


def test_every_sentence_has_a_trigger_and_an_identifier():
    for i, many in lic.SENTENCES.items():
        for s in many:
            assert lic.identify(s) == i and any(t in s.lower() for t in lic.TRIGGERS), s


MIT = "MIT stuff\n\nCopyright (c) 2020 X\n\n" + ". ".join(lic.SENTENCES[i][0].replace(", ", ",\n   ") for i in ("mit-grant",)) + ":\n\n" + ".\n\n".join(lic.SENTENCES[i][0] for i in ("mit-notice", "mit-warranty", "mit-liability")) + ".\n"
CASES = [
    (None, []), ("", []), ("nothing here", []), (MIT, ["MIT"]), ("abc\nLicensed under CC BY-NC 4.0.\nxyz", ["CC-BY-NC-4.0"]), ("A b. RELEASED UNDER  the MIT\nLicence. C", ["MIT"]),
    ("no stop before it\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0"]), ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]), ("# SPDX-License-Identifier: BSD-3-Clause", ["BSD-3-Clause"]),
    ("I have a driving license. It has no warranty.", []), (".\n".join(lic.SENTENCES[i][0] for i in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")), ["BSD-3-Clause"]),
    (".\n".join(lic.SENTENCES[i][0] for i in ("bsd-source", "bsd-grant")), ["BSD"]), ("x" * 300_000 + " warranty. Released under the MIT License.", ["MIT"]), ("İİ\nReleased under the MIT License.", ["MIT"]),
]


def test_licences(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string").selectExpr("*", "1 as spans")
    got = {r.doc_id: r for r in lic.scan_licenses(df).collect()}
    for i, (t, want) in enumerate(CASES):
        assert got[i].licenses == want, t and t[:200]
        for s in got[i].spans:
            assert any(g in t[s.start : s.end].lower() for g in lic.TRIGGERS)
    assert lic.scan_licenses(df.limit(0)).count() == 0


def test_real_lines(spark):
    got = lic.op10_license_scan(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect():
        assert got.licenses[r.doc_id] == ",".join(sorted(v for k, v in lines.items() if k in r.text))


RUNNING = ["{}", "Some words here. {}. More words here.", "# A tool\n# {}\n# of mine"]


@pytest.mark.parametrize("frame", RUNNING)
def test_sentences_and_rules_in_running_text(frame):
    for i, many in lic.SENTENCES.items():
        for s in many:
            assert i in [x for _, _, x in lic.sentences(frame.format(s))], s
    for name, rule in lic.RULES:
        text = frame.format(".\n".join(lic.SENTENCES[i][0] for i in rule))
        assert [h[0] for h in lic.recognise(list(lic.sentences(text)))] == [name], rule


def test_stops_inside_known_sentences(spark):
    gpl, mpl = ". ".join(lic.SENTENCES[i][0] for i in ("gpl-free", "gpl-warranty")), ". ".join(lic.SENTENCES[i][0] for i in ("mpl-header", "mpl-copy"))
    cases = [(gpl, ["GPL-3.0-or-later"]), (mpl + ".", ["MPL-2.0"]), ("// SPDX-License-Identifier: X\n// " + gpl.replace(" you", "\n// you"), ["GPL-3.0-or-later", "X"]), ("Intro: " + gpl + ". " + mpl, ["GPL-3.0-or-later", "MPL-2.0"]), ("This program is free software: you can do what you like.", [])]
    got = lic.scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == {i: want for i, (_, want) in enumerate(cases)}
    url = "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless"
    assert [i for _, _, i in lic.sentences(url) if i] == ["apache-copy"]


def test_all_that_is_identified_passes_the_prefilter(spark):
    kinds = {"CC BY-SA 4.0": "CC-BY-SA-4.0", "CC BY-NC 4.0": "CC-BY-NC-4.0", "CC-BY 4.0": "CC-BY-4.0", "Creative Commons Attribution-ShareAlike 3.0": "CC-BY-SA-3.0"}
    forms = {f"{a}{verb} under {the}{k}{end}": v for a in ("", "This work is ", "This text is ") for verb in ("licensed", "released", "distributed", "available") for the in ("", "the ", "a ") for k, v in kinds.items() for end in ("", " International License")}
    for s, want in forms.items():
        for text in (s.capitalize(), "Words. " + s.replace(" ", "\n* ") + ". More."):
            assert [i for _, _, i in lic.sentences(text) if i] == [f"cc:{want}"], text
    for i, many in lic.SENTENCES.items():
        for s in many:
            assert i in [x for _, _, x in lic.sentences("Words. " + s.replace(" ", "\n * ") + ". More.")], s
    assert lic.recognise(list(lic.sentences("Released under CC BY-SA 4.0.")))[0][0] == "CC-BY-SA-4.0"
    assert list(lic.sentences("He got accepted under ccs, and his domain was public.")) == []


def brute_license(text):
    """Straight from the tables: every stretch of whole lines or sentences, normalised, against every known sentence."""
    words = lic.normalise(text)
    found = {i: [m for s in many for m in [words.find(lic.normalise(s))] if m >= 0] for i, many in lic.SENTENCES.items()}
    return {i for i, at in found.items() if at}


@pytest.mark.parametrize("lay", ["{}", "{}.", " * {}", "\n\n{}\n\n"])
def test_known_sentences_against_brute_force(lay):
    """One known sentence at a time in plain text, laid out in ever odder ways: what the plain search finds is found."""
    for i, many in lic.SENTENCES.items():
        for s in many:
            for shaped in (s, s.replace(" ", "\n"), "\n".join((" " * 24).join(s.split()[k : k + 2]) for k in range(0, len(s.split()), 2)), s.upper()):
                text = "Words that say nothing.\n\n" + lay.format(shaped) + "\n\nMore of them."
                assert i in brute_license(text)
                assert i in [x for _, _, x in lic.sentences(text)], (i, shaped[:80])


def test_named_licences():
    cases = {
        "This file is licensed under the MIT License.": "MIT", "Released under the BSD 3-Clause License.": "BSD-3-Clause", "It is distributed under the terms of the GNU General Public License v3.0.": "GPL-3.0", "This library is available under the LGPL-2.1 license.": "LGPL-2.1",
        "Licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1", "The source code is published under the Apache License 2.0.": "Apache-2.0", "Distributed under GPLv3.": "GPL-3.0", "This software is licensed under the Mozilla Public License 2.0.": "MPL-2.0",
    }
    for text, want in cases.items():
        assert [h[0] for h in lic.recognise(list(lic.sentences("Some words. " + text + " More.")))] == [want], text
    assert lic.recognise(list(lic.sentences("He was released under the cover of night. She is licensed under state law."))) == []
    grant = lic.SENTENCES["mit-grant"][0].split()
    spread = "\n".join((" " * 24).join(grant[k : k + 2]) for k in range(0, len(grant), 2))
    assert [h[0] for h in lic.recognise(list(lic.sentences(spread + ":\n\nText.")))] == ["MIT"]


def test_weights_and_draws_against_brute_force(spark):
    """Raking cell by cell in dictionaries, the factor of the probabilities by halving, draws by their sums."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix_to_targets(docs).toPandas()
    cells = got.groupby(list(mixing.MARGINS), dropna=False).n_tokens.sum().to_dict()
    total = sum(cells.values())
    share = {c: n / total for c, n in cells.items()}
    targets = []
    for k, m in enumerate(mixing.MARGINS):
        raw = {}
        for c, n in cells.items():
            raw[c[k]] = raw.get(c[k], 0) + n
        raw = {v: n ** mixing.TEMPERATURE[m] for v, n in raw.items()}
        targets.append({v: n / sum(raw.values()) for v, n in raw.items()})
    for _ in range(400):
        for k, want in enumerate(targets):
            now = {}
            for c, x in share.items():
                now[c[k]] = now.get(c[k], 0) + x
            share = {c: x * want[c[k]] / now[c[k]] for c, x in share.items()}
    weight = {c: share[c] / (cells[c] / total) for c in cells}
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        if sum(n * min(1.0, mid * weight[c]) for c, n in cells.items()) < 0.5 * total:
            low = mid
        else:
            high = mid
    for r in got.itertuples():
        c = (r.source, r.lang, r.topic)
        assert r.weight == pytest.approx(weight[c], rel=1e-6) and r.probability == pytest.approx(min(1.0, low * weight[c]), rel=1e-6)
    for k, m in enumerate(mixing.MARGINS):
        mass = (got.n_tokens * got.weight).groupby(got[m]).sum() / total
        assert all(mass[v] == pytest.approx(x, abs=1e-6) for v, x in targets[k].items())
    spread = np.sqrt((got.n_tokens**2 * got.probability * (1 - got.probability)).sum())
    assert abs(got.n_tokens[got.selected].sum() - (got.n_tokens * got.probability).sum()) < 4 * spread
    assert got.selected[got.probability >= 1].all() and not got.selected[got.probability <= 0].any()


def test_many_sources_and_whole_rows(spark):
    """Several hundred sources; the rows that are drawn carry all their columns."""
    rows = [(i, f"word{i % 7} and more of it {i}", ["en", "de"][i % 2], f"s{i % 400}", i) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, extra long").selectExpr("*", "1 as topic")
    got = mixing.mix_to_targets(docs).collect()
    drawn = mixing.draw_to_targets(docs).collect()
    assert len({r.source for r in got}) == 400 and {r.doc_id for r in drawn} == {r.doc_id for r in got if r.selected}
    assert all(tuple(r) == (*rows[r.doc_id], 1) for r in drawn)


BSD_HEAD = """Copyright (c) 2009, {h}. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
"""
BSD_NAMES = """   * Neither the name of {h} nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
BSD_OTHER = "   * Nobody may use our names to endorse anything made of it without our written permission.\n"
BSD_END = """
THIS SOFTWARE IS PROVIDED BY {h} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL {h} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL DAMAGES.
"""


@pytest.mark.parametrize("holder", ["Google Inc.", "the University of California", "the copyright holder", "THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "Foo Ltd. and Bar e. V."])
def test_whole_bsd_texts_with_any_holder(holder):
    from chronopath.llm.licenses import recognise, sentences

    named = lambda *parts: [x[0] for x in recognise(list(sentences("Some words.\n\n" + "".join(parts).format(h=holder) + "\nMore words.")))]
    assert named(BSD_HEAD, BSD_NAMES, BSD_END) == ["BSD-3-Clause"]
    assert named(BSD_HEAD, BSD_END) == named(BSD_HEAD) == ["BSD-2-Clause"]
    assert named(BSD_HEAD, BSD_OTHER, BSD_END) == named(BSD_HEAD, BSD_OTHER) == ["BSD"]  # a clause that isn't known: not the two-clause one


@pytest.mark.parametrize(
    "text, licence",
    [
        ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS", "Apache-2.0"),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", "GPL-3.0"),
        ("Foo Bar is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n", "GPL-3.0-or-later"),
        ("The Foo library, v1.2, is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "GPL-2.0"),
        ("gnu libfoo is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later"),
    ],
)
def test_heads_and_notices_with_names(text, licence):
    from chronopath.llm.licenses import recognise, sentences

    assert [x[0] for x in recognise(list(sentences(text)))] == [licence]


def slow_identify(words):
    """Known sentences by trying every way to give names their words."""
    from chronopath.llm.licenses import NAME_WORDS, SENTENCES, _parts

    def fits(want, have):
        if not want:
            return not have
        if want[0] == "*":
            return any(fits(want[1:], have[n:]) for n in range(1, min(NAME_WORDS, len(have)) + 1))
        return bool(have) and want[0] == have[0] and fits(want[1:], have[1:])

    return {i for i, many in SENTENCES.items() for s in many if fits(" * ".join(_parts(s)).split(), words)}


def test_names_against_brute_force():
    from chronopath.llm.licenses import SENTENCES, identify, normalise

    for i, many in SENTENCES.items():
        for s in many:
            for name in ("Foo", "nor the names of", "a " * 12, "a " * 13, ""):
                got = identify(s.replace("<name>", name))
                want = slow_identify(normalise(s.replace("<name>", name)).split())
                assert (got in want) if want else (got is None or ":" in got), (i, name, got, want)


def test_too_many_languages_are_refused_before_topics_are_fitted(spark, monkeypatch):
    from chronopath.llm import mixing

    monkeypatch.setattr(mixing, "MAX_LANGS", 3)
    held = spark.createDataFrame([(i, f"l{i}", b"\0" * (2 * mixing.DIMS)) for i in range(4)], "doc_id long, lang string, x binary")
    with pytest.raises(ValueError, match="languages"):
        mixing.fit_topics(held)
