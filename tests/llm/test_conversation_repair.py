"""Conversation repair against an exhaustive search over edits, and rows damaged by hand."""

import hashlib
import itertools
import re
import zlib

from chronopath.llm.conversation_repair import BLANK, DUPLICATE, TRUNCATED, audits, cheapest, damage, repair, repaired

SCHEMA = "conv_id long, turn long, role string, text string, audit string, n int"
GOOD = re.compile("(s?(ua)+)?")


def search(rows):
    """Least (cost, edits, roles) over all edits with at most two insertions at each place."""
    best = None
    choices = []
    for initial, fault in rows:
        own = [("D", 2, "")]
        if fault not in (BLANK, DUPLICATE):
            more = 5 * (fault == TRUNCATED)
            own += [("K", more, initial), ("R", 1 + more, "u"), ("R", 1 + more, "a")]
        choices.append(own)
    runs = [("", 0, "")] + [("I", 5, x) for x in "ua"] + [("II", 10, x + y) for x in "ua" for y in "ua"]
    for picked in itertools.product(*[x for c in choices for x in (runs, c)], runs):
        roles = "".join(p[2] for p in picked)
        if GOOD.fullmatch(roles):
            now = sum(p[1] for p in picked), "".join(p[0] for p in picked), roles
            best = min(best, now) if best else now
    return best


def test_every_short_conversation():
    for n in range(3):
        for rows in itertools.product([(r, f) for r in "sua t" for f in range(4)], repeat=n):
            cost, audit, _ = search(rows)
            assert cheapest("".join(f"{r}{f}" for r, f in rows)) == (cost, audit)


def test_some_longer_conversations():
    for rows in (["u0", "a3", "u0"], ["s0", "a0", "u3"], ["u0", "u0", "u0"], ["a0", "s0", "a0"], ["s1", "u2", "a0"], ["u3", "a0", "u0"]):
        cost, audit, _ = search([(r[0], int(r[1])) for r in rows])
        assert cheapest("".join(rows)) == (cost, audit)


def brute(rows, conversations):
    """Digest rows by (conversation) after faults found row by row; edits by the machine, applied with its roles."""
    out = {}
    for conv in {r[0] for r in conversations}:
        mine = sorted((r[1:4] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, coded, count = set(), "", [0, 0, 0, 0]
        for _, role, text in mine:
            solid = text.strip(" \t\n\x0b\x0c\r")
            f = 1 if not solid else 2 if (role, text) in seen else 0 if solid[-1] in ".!?" else 3
            seen.add((role, text))
            coded += f"{role[0]}{f}"
            count[f] += 1
        cost, audit = cheapest(coded)
        lines, k, state = [], 0, ""
        for x in audit:
            if x != "I":
                k += 1
            if x == "D":
                continue
            role = mine[k - 1][1] if x == "K" else "assistant" if state.endswith("u") else "user"
            lines.append(f"{role}:{'' if x == 'I' else mine[k - 1][2]}")
            state += role[0]
        assert GOOD.fullmatch(state)
        turns = {r[0] for r in mine} - {None}
        bad = sum(a[1][0] + b[1][0] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count[1:], bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 5, "user", "Hi!"), (1, 6, "assistant", "and then"),
    (2, None, "assistant", "First."), (2, None, "user", "\x0b "), (2, -3, "user", "Q?"), (2, 10**12, "tool", "x" * 200_000 + "."),
    (3, 0, "user", ""), (4, None, "user", "a."), (4, 0, "user", "a."), (4, 1, "assistant", "b\x1c"), (None, 1, "user", "Null conversation."), (None, 2, "assistant", "Yes.\n"), (6, 1, "user", "No answer to this. "), (7, 1, " ", "role of one space."), (8, 0, "user", "same."), (8, 0, "user", "same."), (8, 0, "user", "same."),
]


def test_rows_against_brute_force(spark):
    rows = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA).repartition(4)
    convs = ROWS + [(99, None, "user", "dropped")]
    got = {r.conv_id: tuple(r)[1:] for r in repair(rows, spark.createDataFrame([(c[0],) for c in convs], "conv_id long"))[0].collect()}
    assert got == brute(ROWS, convs)
    assert got[99] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and got[None][6] == "KK"


def test_nulls_are_a_space(spark):
    rows = [(1, 0, None, "a."), (1, 1, "user", None), (2, 0, "", "q.")]
    got = {r.conv_id: (r.blank, r.audit) for r in audits(spark.createDataFrame([(*r, None, 1) for r in rows], SCHEMA)).collect()}
    assert got == {1: (1, "DD"), 2: (0, "D")}


def test_repaired_rows_are_conversations(spark):
    rows = spark.createDataFrame([(*r, None, 1) for r in ROWS], SCHEMA)
    out = repaired(rows, audits(rows)).collect()
    by = {}
    for r in sorted(out, key=lambda r: (str(r.conv_id), r.position)):
        by.setdefault(r.conv_id, []).append(r)
    assert all(GOOD.fullmatch("".join(r.role[0] for r in v)) and [r.position for r in v] == list(range(len(v))) for v in by.values())


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b? c!") for c in range(40) for t in (0, 1, None)] + [(None, 3, None, None)]
    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        if kind:
            want += [(conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (1 + (kind == 3))
    got = damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_long_conversation_and_no_rows(spark):
    rows = spark.range(20_000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('Turn ', id, '.') as text")
    got = repair(rows)[0].first()
    assert (got.cost, got.audit, got.gaps) == (0, "K" * 20_000, 0)
    assert repair(rows.limit(0))[0].count() == 0
