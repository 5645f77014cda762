"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Token counts by (source, language, topic) are raked until their margins are the targets; a cell's raked share over its
own share is its weight, and a document is drawn with probability min(1, c * weight), c chosen so that the expected
tokens are the wanted part of all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from chronopath.llm.common import chunks, drop_path, few, materialize, small_batches, texts
from chronopath.llm.ngram_join import _K, mix, word_hashes
from chronopath.llm.toxicity import _GAP

TOPICS, DIMS, ROUNDS, MAX_CELLS = 8, 512, 20, 1_000_000
#: Languages whose topics are fitted; TOPICS centres of 4 kB each are held at the driver and sent to every task.
MAX_LANGS = 2_000
#: Fixed-point units of a profile's and a centre's numbers: their products sum up exactly in a double, in any order.
UNIT, CENTRE_UNIT = 65535, 32767
#: Partial results that a worker holds before it hands them on.
HELD = 4096
MARGINS = ("source", "lang", "topic")
#: Without given targets a margin's shares are its token shares to this power, normalised.
TEMPERATURE = {"source": 0.5, "lang": 0.7, "topic": 0.7}
NULL = "\u0000null"


def profiles(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(unit word profiles over DIMS hashed words, number of words) of some texts."""
    edges = np.cumsum([0] + [len(r) + 1 for r in raw])
    at, h = word_hashes(np.frombuffer(b"\n".join([*raw, b""]), np.uint8), _GAP)
    own = np.searchsorted(edges, at, "right") - 1
    n = len(raw)
    x = np.sqrt(np.bincount(own * DIMS + (mix(h ^ _K[3]) >> np.uint64(55)).astype(np.int64), minlength=n * DIMS)[: n * DIMS].reshape(n, DIMS).astype(np.float64))
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12), np.bincount(own, minlength=n)


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts(b)]
        for i, j in chunks(raw):
            x, n = profiles(raw[i:j])
            part = b.slice(i, j - i)
            x = np.rint(x * UNIT).astype(np.uint16)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").cast(pa.int64()), "source": part.column("source"), "lang": part.column("lang"), "n_tokens": pa.array(n.astype(np.int64)), "x": pa.array([v.tobytes() for v in x], pa.binary())})


def _by_lang(b: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, row numbers, profiles) of a batch's rows."""
    x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.uint16).reshape(-1, DIMS)
    lang = np.array([v if v is not None else NULL for v in b.column("lang").to_pylist()], object)
    for name in sorted({*lang}):
        at = np.flatnonzero(lang == name)
        yield name, at, x[at].astype(np.float64)


def _gather(held: DataFrame, part: Callable[[pa.RecordBatch], Iterable[tuple[str, int, int, bytes]]], merge: Callable) -> dict[tuple[str, int], tuple[int, bytes]]:
    """The (n, v) that ``merge`` makes of all rows (language, k, n, v) of the batches, by language and k."""

    def merged(rows: Iterable[tuple[str, int, int, bytes]]) -> Iterator[dict]:
        got: dict[tuple[str, int], tuple[int, bytes]] = {}
        for lang, k, n, v in rows:
            got[lang, k] = merge(got[lang, k], (n, v)) if (lang, k) in got else (n, v)
            if len(got) > HELD:
                yield got
                got = {}
        if got:
            yield got

    def run(rows_of: Callable):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for got in merged(r for b in batches for r in rows_of(b)):
                yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in got], pa.string()), "k": pa.array([k[1] for k in got], pa.int32()), "n": pa.array([v[0] for v in got.values()], pa.int64()), "v": pa.array([v[1] for v in got.values()], pa.binary())})

        return task

    kind = "lang string, k int, n long, v binary"
    rows = held.mapInArrow(run(part), kind).repartition("lang", "k").coalesce(held.rdd.getNumPartitions()).mapInArrow(run(lambda b: zip(*(c.to_pylist() for c in b.columns), strict=True)), kind)
    out: dict[tuple[str, int], tuple[int, bytes]] = {}
    for r in rows.collect():
        new = r.n, bytes(r.v)
        out[r.lang, r.k] = merge(out[r.lang, r.k], new) if (r.lang, r.k) in out else new
    return out


def _add(a: tuple[int, bytes], b: tuple[int, bytes]) -> tuple[int, bytes]:
    return a[0] + b[0], (np.frombuffer(a[1], np.int64) + np.frombuffer(b[1], np.int64)).tobytes()


def _scaled(v: np.ndarray) -> np.ndarray:
    return np.rint(v / max(np.linalg.norm(v), 1e-12) * CENTRE_UNIT).astype(np.uint16)


def _likeness(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return x @ centres.T.astype(np.float64)


def fit_topics(held: DataFrame, topics: int = TOPICS) -> dict[str, np.ndarray]:
    """Topic centres of each language by spherical k-means, largest topic first.

    Fitted on all rows of ``held(doc_id, lang, x)`` that have words: Spark sums profiles and counts by language and
    centre each round, so what is collected and sent is DIMS numbers a centre. Starts are the text of least doc_id and
    then the texts least like those taken. All sums are exact, so the partitioning doesn't matter. Topics are numbered
    within a language, since words divide languages before anything else and a topic that lies within one language
    could not be raked beside it.
    """
    centres: dict[str, np.ndarray] = {}
    if (langs := held.select("lang").distinct().limit(MAX_LANGS + 1).count()) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages ({langs} seen): map rare ones to one name first")
    held = held.coalesce(few(held.count(), 2_000))  # dozens of passes over a table that is small beside the texts

    def first(b: pa.RecordBatch) -> Iterator[tuple[str, int, int, bytes]]:
        ids = b.column("doc_id").to_pylist()
        for lang, at, x in _by_lang(b):
            for i in np.flatnonzero(x.any(1)).tolist():
                d = ids[at[i]]
                yield lang, 0, (1 << 63) - 1 if d is None else d, x[i].astype(np.uint16).tobytes()

    def farthest(b: pa.RecordBatch) -> Iterator[tuple[str, int, int, bytes]]:
        for lang, _, x in _by_lang(b):
            x = x[x.any(1)]
            if len(x):
                like = _likeness(x, centres[lang]).max(1)
                for i in np.flatnonzero(like == like.min()).tolist():
                    yield lang, 0, int(like[i]), x[i].astype(np.uint16).tobytes()

    def sums(b: pa.RecordBatch) -> Iterator[tuple[str, int, int, bytes]]:
        for lang, _, x in _by_lang(b):
            x = x[x.any(1)]
            if len(x):
                own = _likeness(x, centres[lang]).argmax(1)
                for k in np.unique(own).tolist():
                    yield lang, k, int((own == k).sum()), x[own == k].sum(0).astype(np.int64).tobytes()

    def taken(v: bytes) -> np.ndarray:
        return _scaled(np.frombuffer(v, np.uint16).astype(np.float64))[None]

    centres = {lang: taken(v) for (lang, _), (_, v) in _gather(held, first, min).items()}
    for _ in range(1, topics if centres else 1):
        centres = {lang: np.r_[centres[lang], taken(v)] for (lang, _), (_, v) in _gather(held, farthest, min).items()}
    for _ in range(ROUNDS if centres else 0):
        now = {lang: c.copy() for lang, c in centres.items()}
        for (lang, k), (_, v) in _gather(held, sums, _add).items():
            now[lang][k] = _scaled(np.frombuffer(v, np.int64).astype(np.float64))
        settled = all((now[lang] == c).all() for lang, c in centres.items())
        centres = now
        if settled:
            break
    size = {lang: np.zeros(len(c), np.int64) for lang, c in centres.items()}
    for (lang, k), (n, _) in (_gather(held, sums, _add) if centres else {}).items():
        size[lang][k] = n
    return {lang: c[np.argsort(-size[lang], kind="stable")] for lang, c in centres.items()}


def _nearest(b: pa.RecordBatch, centres: dict[str, np.ndarray]) -> np.ndarray:
    """Topic of each row of ``(lang, x)``."""
    topic = np.zeros(b.num_rows, np.int64)
    for lang, at, x in _by_lang(b):
        if lang in centres:
            topic[at] = _likeness(x, centres[lang]).argmax(1)
    return topic


def _facts(centres: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "source": b.column("source"), "lang": b.column("lang"), "topic": pa.array([f"t{t}" for t in _nearest(b, centres)], pa.string()), "n_tokens": b.column("n_tokens")})

    return run


def targets_of(names: list[str], tokens: np.ndarray, given: dict[str, float] | None, power: float) -> np.ndarray:
    """Target shares of a margin's values: those given, else token shares to ``power``; values not given share nothing."""
    raw = np.array([given.get(n, 0.0) for n in names]) if given else tokens.astype(np.float64) ** power * (tokens > 0)
    return raw / raw.sum() if raw.sum() > 0 else raw


def rake(cells: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], rounds: int = 200, tolerance: float = 1e-12) -> np.ndarray:
    """Iterative proportional fitting: shares of the cells whose margins are the targets (as far as empty cells allow)."""
    share = tokens / max(tokens.sum(), 1e-300)
    for _ in range(rounds):
        worst = 0.0
        for at, want in zip(cells, targets, strict=True):
            now = np.bincount(at, share, len(want))
            factor = np.where(now > 0, want / np.where(now > 0, now, 1), 0.0)
            worst = max(worst, np.abs(now - want)[now > 0].max(initial=0.0))
            share = share * factor[at]
        if worst < tolerance:
            break
    return share


def calibrate(weight: np.ndarray, tokens: np.ndarray, part: float) -> np.ndarray:
    """Probabilities min(1, c * weight) that keep ``part`` of all tokens in expectation (all, if weights can't reach it)."""
    want, order = part * tokens.sum(), np.argsort(-weight, kind="stable")
    w, t = weight[order], tokens[order].astype(np.float64)
    sure, mass = np.r_[0.0, np.cumsum(t)], np.r_[np.cumsum((w * t)[::-1])[::-1], 0.0]
    for k in range(len(w)):  # the first k cells are kept whole
        c = (want - sure[k]) / mass[k] if mass[k] > 0 else np.inf
        if c * w[k] <= 1:
            return np.minimum(1.0, max(c, 0.0) * weight)
    return np.where(weight > 0, 1.0, 0.0)


def _draw(seed: int):
    """A number in (0, 1) from doc_id and seed alone."""
    return F.expr(f"(shiftrightunsigned(xxhash64(coalesce(doc_id, 0L), {seed}L), 11) + 0.5D) / 9007199254740992D")


def _cells(held: DataFrame, centres: dict[str, np.ndarray], targets: dict[str, dict[str, float]] | None, part: float) -> tuple[DataFrame, DataFrame, str]:
    """(topics of all texts, cells with weight and probability, folder of the first)."""
    spark = held.sparkSession
    facts, path = materialize(held.mapInArrow(_facts(centres), "doc_id long, source string, lang string, topic string, n_tokens long"), "mixing")
    cells = facts.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    rows = cells.limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic")
    rows.sort(key=lambda r: tuple(v if v is not None else NULL for v in r[:3]))
    tokens = np.array([r.tokens for r in rows], np.float64)
    at, want = [], []
    for i, m in enumerate(MARGINS):
        names, index = np.unique([r[i] if r[i] is not None else NULL for r in rows], return_inverse=True) if rows else (np.empty(0, str), np.empty(0, np.int64))
        at.append(index)
        want.append(targets_of(names.tolist(), np.bincount(index, tokens, len(names)), (targets or {}).get(m), TEMPERATURE[m]))
    share = rake(at, tokens, want)
    weight = np.where(tokens > 0, share / np.maximum(tokens / max(tokens.sum(), 1e-300), 1e-300), 0.0)
    probability = calibrate(weight, tokens, part)
    table = spark.createDataFrame([(r.source, r.lang, r.topic, float(w), float(p)) for r, w, p in zip(rows, weight, probability, strict=True)], "s string, l string, t string, weight double, probability double")
    return facts, F.broadcast(table) if len(rows) <= 10_000 else table, path


def _with_cell(rows: DataFrame, table: DataFrame, names: tuple[str, str, str] = MARGINS) -> DataFrame:
    s, l, t = names
    return rows.join(table, rows[s].eqNullSafe(F.col("s")) & rows[l].eqNullSafe(F.col("l")) & (rows[t] == F.col("t")), "left")


def _profiles_of(docs: DataFrame) -> tuple[DataFrame, str]:
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")).mapInArrow(_profiled, "doc_id long, source string, lang string, n_tokens long, x binary"), "mixing-profiles")


def mix_to_targets(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, part: float = 0.5, topics: int = TOPICS, seed: int = 1) -> DataFrame:
    """``(doc_id, source, lang, topic, n_tokens, weight, probability, selected)`` of each row of ``docs``.

    ``docs(doc_id, text, lang, source)``, other columns ignored. Targets map ``source``, ``lang`` and ``topic`` to
    shares; a margin without targets is smoothed by TEMPERATURE. Null sources and languages are values of their own.
    Tokens are words; texts without words (null, empty) have weight and probability of their cell, and 0 where the cell
    has no tokens. Draws depend on doc_id and seed alone (null: one draw for all). Cells are counted in Spark; their
    table comes to the driver only while it has at most MAX_CELLS rows, and more is an error that names the bound.
    """
    held, path = _profiles_of(docs)
    facts, table, _ = _cells(held, fit_topics(held, topics), targets, part)
    drop_path(docs.sparkSession, path)
    out = _with_cell(facts, table)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", (_draw(seed) < F.col("probability")).alias("selected"))


def _topics(centres: dict[str, np.ndarray]):
    """Whole rows with the topic of their text, by the profiles that the centres were fitted on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, lang = [t.encode("utf-8", "surrogatepass") for t in texts(b)], b.column("_lang")
            for i, j in chunks(raw):
                x = np.rint(profiles(raw[i:j])[0] * UNIT).astype(np.uint16)
                of = pa.RecordBatch.from_pydict({"lang": lang.slice(i, j - i), "x": pa.array([v.tobytes() for v in x], pa.binary())})
                yield b.slice(i, j - i).append_column("_topic", pa.array([f"t{t}" for t in _nearest(of, centres)], pa.string()))

    return run


def draw_to_targets(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, part: float = 0.5, topics: int = TOPICS, seed: int = 1) -> DataFrame:
    """Rows of ``docs`` that ``mix_to_targets`` selects, with all their columns; each row is drawn by its own cell, so
    rows that share a doc_id have one draw and may have two probabilities. Texts are not shuffled."""
    held, path = _profiles_of(docs)
    centres = fit_topics(held, topics)
    _, table, facts_path = _cells(held, centres, targets, part)
    drop_path(docs.sparkSession, path, facts_path)
    small_batches(docs.sparkSession)
    keyed = docs.withColumns({"_source": F.col("source").cast("string"), "_lang": F.col("lang").cast("string")})
    schema = StructType([*keyed.schema.fields, StructField("_topic", StringType())])
    return _with_cell(keyed.mapInArrow(_topics(centres), schema), table, ("_source", "_lang", "_topic")).where(_draw(seed) < F.col("probability")).select(*docs.columns)


def op9_mix_to_targets(spark, sf_dir: str) -> DataFrame:
    return mix_to_targets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
