"""Filter audit against a walk over every row for every order."""

import itertools
import re

from chronopath.llm.filter_audit import ORDERS, filter_audit

SPACE = "[\\x20\\x09-\\x0D]"
LONG = " ".join(f"w{i}" for i in range(300))
DOCS = [
    (1, LONG, "en"), (2, LONG, "en"), (3, LONG, "de"), (3, LONG, "de"), (None, LONG, "en"), (None, LONG, None), (4, "", "en"), (5, None, "en"), (6, "A B C # " * 60, None), (7, "A B C # " * 60, ""),
    (8, "\x0b\x1c one\x0ctwo " * 50, "fr"), (9, "Éa Éb " * 80, "fr"), (10, LONG + " |", "de"), (10, "short", "de"), (11, "short", "de"), (12, "é" * 99 + "ABCDEFGHIJK", "de"), (13, "x " * 100_000, "de"), (0, LONG, "xx"), (15, "É" * 10 + "A", "yy"), (16, "a" * 9 + "A", "yy"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (None, 1, 1), (6, 1, None), (10, 1, 1), (99, 1, 1), (11, 1, 0)]


def brute(docs, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = [x for x in re.split(SPACE + "+", t) if x]
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = [len(left), len(here), sum(f in r[1] for r in mine) - len(here), sum(r[1] == {f} for r in mine), sum(r[2] for r in here), sum(r[3] for r in here)]
    for (part, order, step), v in out.items():
        f = order[step - 1]
        v.append(sum(out[part, "".join(o), o.index(f) + 1][1] for o in itertools.permutations("ABCDE")))
    return out


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(*d, "x", 1, 2) for d in DOCS], "doc_id long, text string, lang string, part string, mask int, n int").repartition(5)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit(docs, labels).collect()}
    assert got == brute(DOCS, LABELS)


def test_many_copies_are_counted_once_a_task(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'same text' as text", "'en' as lang")
    got = filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'EABCD' and step = 1").first()
    assert (got.kept, got.removed, got.unique_fails) == (1, 2999, 0)  # all fail A as well


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert len(ORDERS) == 120
