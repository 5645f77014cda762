"""Conversation repair by weighted finite-state composition.

Three machines: an acceptor of a conversation's rows (each a role's initial and a fault), a transducer of edits, and an
acceptor of the role grammar. Their composition is explored lazily from the last row back: a weight is a cost with the
string of edits that it pays for, compared as a pair, and the states (row, grammar state) come in topological order, so
each is settled once. Edits of one state that lead on differ in their letter, as the grammar has one successor for each
role; the least string is thus known from its first letter.

Spark finds faults that need other rows (a role and text seen earlier) by grouping digests. One shuffle deals a few
bytes a row, in order, to the composition, another the rows with their texts to the one that applies the edits; both
stream, so texts are never held for a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopath.llm.common import materialize, small_batches

# The role grammar (s?(ua)+)?: states and what leads on from them.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
GRAMMAR = {START: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U}}
ACCEPTING = (START, AFTER_A)
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5  # costs
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)  # faults
GIVEN = {"u": "user", "a": "assistant"}  # roles that Rerole and Insert can give
NEVER = 1 << 60


def edits(initial: str, fault: int) -> Iterator[tuple[str, int, str]]:
    """The edit transducer's arcs for a row: (letter, cost, role initial given or empty)."""
    yield "D", DELETE, ""
    if fault not in (BLANK, DUPLICATE):
        more = UNFINISHED * (fault == TRUNCATED)
        yield "K", KEEP + more, initial
        for role in GIVEN:
            yield "R", REROLE + more, role


@lru_cache(maxsize=4096)
def arcs(initial: str, fault: int) -> list[list[tuple[int, str, int]]]:
    """Arcs of the composed machine that read a row, for each grammar state: (cost, letter, next state)."""
    out = []
    for q in GRAMMAR:
        led = [(cost, letter, GRAMMAR[q].get(role) if role else q) for letter, cost, role in edits(initial, fault)]
        out.append(sorted(a for a in led if a[2] is not None))
    return out


#: Insertions read no row: (state, next state), first those from which one more insertion can lead on.
INSERTIONS = [(q, n) for q in GRAMMAR for role, n in GRAMMAR[q].items() if role in GIVEN]


def _settle(cost: list[int], letter: list[str], to: list[int]) -> None:
    """Insertions before the next row: two rounds, as a third in a row would come back to a state it has been in."""
    for _ in range(2):
        for q, n in INSERTIONS:
            if (cost[n] + INSERT, "I") < (cost[q], letter[q]):
                cost[q], letter[q], to[q] = cost[n] + INSERT, "I", n


def cheapest(rows: str) -> tuple[int, str]:
    """Cost and least string of edits; ``rows`` has two characters a row, the role's initial and the fault's number."""
    cost, letter, to = [0 if q in ACCEPTING else NEVER for q in GRAMMAR], [""] * 4, [-1] * 4
    _settle(cost, letter, to)
    layers = [(bytes(map(ord, (x or "." for x in letter))), bytes(x + 1 for x in to))]
    for i in range(len(rows) - 2, -1, -2):
        new_cost, letter, to = [NEVER] * 4, [""] * 4, [-1] * 4
        for q, leads in enumerate(arcs(rows[i], int(rows[i + 1]))):
            for c, x, n in leads:
                if (cost[n] + c, x) < (new_cost[q], letter[q] or "~"):
                    new_cost[q], letter[q], to[q] = cost[n] + c, x, n
        cost = new_cost
        _settle(cost, letter, to)
        layers.append((bytes(map(ord, letter)), bytes(x + 1 for x in to)))
    q, out = START, []
    while layers:
        letters, nexts = layers[-1]
        x = chr(letters[q])
        if x == ".":
            break
        out.append(x)
        q = nexts[q] - 1
        if x != "I":
            layers.pop()
    return cost[START], "".join(out)


@lru_cache(maxsize=50_000)
def _short(rows: str) -> tuple[int, str]:
    return cheapest(rows)


def damage(rows: DataFrame) -> DataFrame:
    """Damaged ``(conv_id, turn, role, text)``, by ``crc32(conv_id:turn) % 20``: 0 drops a row, 1 empties its text, 2
    takes ``.!?`` out of it, 3 repeats it, 4 makes the role user. A null stands for one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("kind")
    hit = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _order() -> list:
    return [F.col("turn").asc_nulls_first(), "role", "d1", "d2"]


def _keyed(rows: DataFrame) -> DataFrame:
    role = F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit(" "))
    text = F.coalesce("text", F.lit(" "))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(7), text).alias("d2"))


def _fault(text: Column) -> Column:
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(NONE)


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Faults and edits of each conversation, from its rows in order (a row without ``n`` only names one)."""
    names = ("conv_id", "turn", "role", "d1", "d2", "fault", "n", "earlier")
    now: dict | None = None
    held: list[dict] = []

    def out() -> pa.RecordBatch:
        cols = {c: pa.array([h[c] for h in held], pa.string() if c == "audit" else pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")}
        held.clear()
        return pa.RecordBatch.from_pydict(cols)

    def done(c: dict) -> None:
        rows = "".join(c.pop("rows"))
        c["cost"], c["audit"] = _short(rows) if len(rows) <= 64 else cheapest(rows)
        lo, hi, turns = c.pop("lo"), c.pop("hi"), c.pop("turns")
        c["gaps"] = hi - lo + 1 - turns if turns else 0
        held.append(c)

    for b in batches:
        for conv, turn, role, _, _, fault, n, earlier in zip(*(b.column(c).to_pylist() for c in names), strict=True):
            if now is None or now["conv_id"] != conv:
                if now is not None:
                    done(now)
                now = {"conv_id": conv, "rows": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "lo": 0, "hi": 0, "turns": 0}
                before = None
            if n is None:
                continue
            if turn is not None:
                if not now["turns"]:
                    now["lo"] = now["hi"] = turn
                    now["turns"] = 1
                elif turn != now["hi"]:
                    now["turns"], now["hi"] = now["turns"] + 1, turn
            initial = role[0]
            # Equal rows of a turn came as one with their number; all but the very first of them are duplicates.
            first = DUPLICATE if earlier and fault != BLANK else fault
            again = BLANK if fault == BLANK else DUPLICATE
            now["rows"].append(f"{initial}{first}" + f"{initial}{again}" * (n - 1))
            now["illegal"] += (before is not None and before + initial not in ("su", "ua", "au")) + (n - 1 if initial + initial not in ("su", "ua", "au") else 0)
            before = initial
            for f, k in ((first, 1), (again, n - 1)):
                for name, number in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED)):
                    now[name] += k * (f == number)
            if len(held) >= 1000:
                yield out()
    if now is not None:
        done(now)
    if held:
        yield out()


def audits(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of each conversation of ``rows``, and of
    those of ``conversations`` that have no rows."""
    keyed = _keyed(rows).select("conv_id", "turn", "role", "d1", "d2", _fault(F.col("text")).alias("fault"))
    once = keyed.groupBy("conv_id", "turn", "role", "d1", "d2", "fault").agg(F.count(F.lit(1)).alias("n"))
    # The earliest turn of a role and text in a conversation, null before all others.
    firsts = keyed.groupBy("conv_id", "role", "d1", "d2").agg(F.max(F.col("turn").isNull()).alias("f_null"), F.min("turn").alias("f_turn"))
    firsts = firsts.withColumnsRenamed({c: "f_" + c for c in ("conv_id", "role", "d1", "d2")})
    same = F.col("conv_id").eqNullSafe(F.col("f_conv_id")) & (F.col("role") == F.col("f_role")) & (F.col("d1") == F.col("f_d1")) & (F.col("d2") == F.col("f_d2"))
    earlier = F.col("turn").isNotNull() & (F.col("f_null") | (F.col("f_turn") < F.col("turn")))
    read = once.join(firsts, same).select("conv_id", "turn", "role", "d1", "d2", "fault", "n", earlier.alias("earlier"))
    if conversations is not None:
        read = read.unionByName(conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), allowMissingColumns=True)
    read = read.repartition("conv_id").sortWithinPartitions("conv_id", F.col("n").isNotNull(), *_order())
    return read.mapInArrow(_compose, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows after their edits, in order: each conversation's audit comes first, then its rows."""
    kinds = {"conv_id": pa.int64(), "position": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}
    audit, at, q, position, left = "", 0, START, 0, 0

    def insertions(conv):
        nonlocal at, q, position
        while at < len(audit) and audit[at] == "I":
            initial = next(r for r in GRAMMAR[q] if r in GIVEN)
            q, at, position = GRAMMAR[q][initial], at + 1, position + 1
            yield conv, position - 1, "I", GIVEN[initial], ""

    for b in batches:
        out: list[tuple] = []
        for conv, word, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
            if word is not None:
                audit, at, q, position, left = word, 0, START, 0, len(word) - word.count("I")
                continue
            out += insertions(conv)
            x = audit[at]
            at, left = at + 1, left - 1
            if x != "D":
                initial = role[0] if x == "K" else next(r for r in GRAMMAR[q] if r in GIVEN)
                q = GRAMMAR[q][initial]
                out.append((conv, position, x, role if x == "K" else GIVEN[initial], text))
                position += 1
            if not left:
                out += insertions(conv)  # after the last row
        yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(kinds.items())})


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows ``(conv_id, position, edit, role, text)`` after the edits of ``found(conv_id, audit)``; a conversation's
    rows follow each other in order in one partition."""
    small_batches(rows.sparkSession)
    both = _keyed(rows).unionByName(found.select("conv_id", "audit"), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_order()).mapInArrow(_edit, "conv_id long, position long, edit string, role string, text string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, sha, held = None, None, []

    def out() -> pa.RecordBatch:
        got = pa.RecordBatch.from_pydict({"conv_id": pa.array([h[0] for h in held], pa.int64()), "repaired_sha256": pa.array([h[1] for h in held], pa.string())})
        held.clear()
        return got

    for b in batches:
        for conv, position, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")), strict=True):
            if position == 0:
                if sha is not None:
                    held.append((now, sha.hexdigest()))
                now, sha = conv, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        if len(held) >= 1000:
            yield out()
    if sha is not None:
        held.append((now, sha.hexdigest()))
    if held:
        yield out()


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> tuple[DataFrame, str]:
    """The audits of ``rows`` with ``repaired_sha256``, the digest of the repaired ``role:text`` lines; and the folder of
    the table that the result reads, to be dropped by the caller.

    Rows are taken by turn, null first, then by role and a hash of the text; equal rows are duplicates of the first.
    Null or empty roles and null texts are one space; rows without a conv_id are one conversation. Other columns are
    ignored, no rows give no audits but for ``conversations``. A task holds six bytes a row of one conversation, which
    its audit, one cell, needs anyway; texts stream, however long or many.
    """
    found, path = materialize(audits(rows, conversations), "conversation-audits")
    digests = repaired(rows, found).mapInArrow(_digest, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "r_conv")
    out = found.join(digests, F.col("conv_id").eqNullSafe(F.col("r_conv")), "left").drop("r_conv")
    return out.na.fill({"repaired_sha256": hashlib.sha256(b"").hexdigest()}), path


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair(damage(rows), rows)[0]


# The damage's crc32 bit by bit, and the composed machine's arcs with the insertions before a row as a table.
SQL = r"""WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS varchar), ' ') || ':' || coalesce(CAST(turn AS varchar), ' ') AS k FROM conversations),
x AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(k) + 1), lambda i: list_concat([ascii(k[i])::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1])))), lambda c, b: CASE WHEN b >= 0 THEN CASE WHEN (xor(c, b) & 1) = 1 THEN xor(xor(c, b) >> 1, 3988292384::BIGINT) ELSE xor(c, b) >> 1 END WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT) % 20 AS d FROM o),
g AS (SELECT conv_id, turn, CASE WHEN d = 4 OR role = '' THEN CASE WHEN d = 4 THEN 'user' ELSE ' ' END ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM x WHERE d <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS z, left(role, 1) AS r FROM g),
f AS (SELECT *, CASE WHEN z = '' THEN 1 WHEN seen > 1 THEN 2 WHEN z NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM n),
ins(q, t, w, c, s) AS (VALUES (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''), (0, 2, 'I', 5, 'user:' || chr(10)), (0, 3, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 2, 'I', 5, 'user:' || chr(10)), (1, 3, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 3, 'I', 5, 'assistant:' || chr(10)), (3, 2, 'I', 5, 'user:' || chr(10))),
go(q, role, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ed AS (SELECT f.conv_id, f.i, NULL AS own, 'D' AS w, 2 AS c, '' AS s FROM f UNION ALL SELECT conv_id, i, r, 'K', CASE WHEN fault = 3 THEN 5 ELSE 0 END, role || ':' || text || chr(10) FROM f WHERE fault IN (0, 3)
 UNION ALL SELECT conv_id, i, left(v, 1), 'R', CASE WHEN fault = 3 THEN 6 ELSE 1 END, v || ':' || text || chr(10) FROM f, (SELECT unnest(['user', 'assistant']) AS v) WHERE fault IN (0, 3)),
b AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'c': 0, 'w': '', 's': ''} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
 UNION ALL SELECT conv_id, i, q, min({'c': c, 'w': w, 's': s}) FROM (SELECT b.conv_id, ed.i, coalesce(go.t, ins.t) AS q, CAST(best.c + ins.c + ed.c AS INTEGER) AS c, best.w || ins.w || ed.w AS w, best.s || ins.s || ed.s AS s FROM b JOIN ins ON ins.q = b.q JOIN ed ON ed.conv_id IS NOT DISTINCT FROM b.conv_id AND ed.i = b.i + 1 LEFT JOIN go ON go.q = ins.t AND go.role = ed.own WHERE ed.own IS NULL OR go.t IS NOT NULL) GROUP BY 1, 2, 3),
h AS (SELECT conv_id, max(i) AS i FROM b GROUP BY 1),
e AS (SELECT b.conv_id, min({'c': best.c + ins.c, 'w': best.w || ins.w, 's': best.s || ins.s}) AS best FROM b JOIN h ON h.conv_id IS NOT DISTINCT FROM b.conv_id AND h.i = b.i JOIN ins ON ins.q = b.q AND ins.t IN (0, 3) GROUP BY 1),
k AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (p IS NOT NULL AND p || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS bigint) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best.c AS bigint) AS cost, best.w AS audit, sha256(CASE WHEN best.s = '' THEN '' ELSE left(best.s, -1) END) AS repaired_sha256 FROM e LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM e.conv_id"""
