"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from document labels.

A sentence's score is the logistic of its words' and word pairs' weights; a document is toxic unless every sentence
and a constant leak (label noise that no sentence explains) leave it clean: p = 1 - exp(-leak - sum softplus(z)).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopath.llm.common import chunks, drop_path, materialize, small_batches, texts
from chronopath.llm.ngram_join import _K, mix, word_hashes

#: Bounds of the training sample (by least hash of doc_id) and of the model.
MAX_TOXIC, MAX_CLEAN, FEATURES, LEAST_DOCS = 1500, 3000, 4000, 4
EPOCHS, RATE, L2 = 220, 0.08, 2e-2
U = np.uint64
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_STOP = np.zeros(256, bool)
_STOP[[10, 13, 33, 46, 63]] = True  # line ends ! . ?


@dataclass
class Bags:
    """Words of some texts: hash, hash with the word before (0 at a sentence's start), sentence and text of each."""

    word: np.ndarray
    pair: np.ndarray
    start: np.ndarray  # first word of each sentence
    owner: np.ndarray  # text of each sentence
    span: np.ndarray  # byte range of each sentence in its text


def bags(raw: list[bytes]) -> Bags:
    edges = np.cumsum([0] + [len(r) + 1 for r in raw])
    buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    at, h = word_hashes(buf, _GAP)
    if not len(at):
        return Bags(h, h, at, at, np.zeros((0, 2), np.int64))
    sentence = np.cumsum(_STOP[buf])[at]
    new = np.r_[True, sentence[1:] != sentence[:-1]]
    pair = np.zeros(len(h), U)
    pair[1:] = mix(h[:-1] * _K[1] + h[1:] + U(1)) | U(1)
    pair[new] = 0
    start = np.flatnonzero(new)
    owner = np.searchsorted(edges, at[start], "right") - 1
    stops = np.flatnonzero(_STOP[buf])
    ends = stops[np.searchsorted(stops, at[start])]
    span = np.stack([at[start], ends], 1) - edges[owner][:, None]
    return Bags(h, pair, start, owner, span)


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float
    leak: float

    def __post_init__(self):
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.keys >> U(42)] = True

    def _weights(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h))
        at = np.flatnonzero(self.seen[h >> U(42)])
        if len(at) and len(self.keys):
            k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            out[at] = np.where(self.keys[k] == h[at], self.weights[k], 0.0)
        return out

    def sentences(self, b: Bags) -> np.ndarray:
        if not len(b.start):
            return np.zeros(0)
        return self.bias + np.add.reduceat(self._weights(b.word) + self._weights(b.pair), b.start)

    def documents(self, z: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return -np.expm1(-self.leak - np.bincount(owner, np.logaddexp(0, z), n))


@dataclass
class Sample:
    """Labelled texts as the features that the model may use: of each text, (feature, sentence) of every occurrence."""

    feature: list[np.ndarray]
    sentence: list[np.ndarray]
    n_sentences: list[int]
    toxic: np.ndarray
    weight: np.ndarray


def train(keys: np.ndarray, docs: Sample) -> Model:
    """Fit by Adam over the whole sample; keys: sorted hashes of the features."""
    toxic, weight = docs.toxic, docs.weight
    if not len(toxic) or toxic.min() == toxic.max():  # nothing to tell apart: the share of toxic labels
        share = float(np.clip(toxic.mean() if len(toxic) else 0.0, 0, 1 - 1e-9))
        return Model(np.empty(0, U), np.empty(0), -40.0, float(-np.log1p(-share)))
    size = np.array(docs.n_sentences, np.int64)
    start = np.zeros(int(size.sum()))
    own = np.repeat(np.arange(len(size)), size)
    f, s = np.concatenate(docs.feature), np.concatenate([x + o for x, o in zip(docs.sentence, np.r_[0, np.cumsum(size)[:-1]].tolist(), strict=True)])
    n, y = len(toxic), toxic.astype(np.float64)
    theta = np.r_[np.zeros(len(keys)), -5.0, -3.0]  # weights, bias, log leak
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = weight.sum()
    for t in range(1, EPOCHS + 1):
        zs = theta[-2] + np.bincount(s, theta[f], len(start))
        leak = np.exp(theta[-1])
        hazard = leak + np.bincount(own, np.logaddexp(0, zs), n)
        slope = weight * np.where(y > 0, -1 / np.maximum(np.expm1(np.minimum(hazard, 700)), 1e-9), 1.0) / total  # d loss / d hazard
        gs = slope[own] / (1 + np.exp(np.clip(-zs, -700, 700)))
        g = np.r_[np.bincount(f, gs[s], len(keys)) + L2 / max(1, len(keys)) * theta[:-2], gs.sum(), slope.sum() * leak]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return Model(keys, theta[:-2], float(theta[-2]), float(np.exp(theta[-1])))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, documents, toxic documents) of each batch."""
    for b in batches:
        toxic, which = np.asarray(b.column("toxic"), dtype=np.int64), []
        for t in texts(b):
            x = bags([t.encode("utf-8", "surrogatepass")])
            which.append(np.unique(np.concatenate([x.word, x.pair[x.pair != 0]])))
        keys, back = np.unique(np.concatenate(which), return_inverse=True)
        own = np.repeat(toxic, [len(w) for w in which])
        yield pa.RecordBatch.from_pydict({"feature": pa.array(keys.view(np.int64)), "df": pa.array(np.bincount(back, minlength=len(keys)).astype(np.int64)), "pos": pa.array(np.bincount(back, own, len(keys)).astype(np.int64))})


def _indexed(keys: np.ndarray):
    """Of each text the (feature, sentence) of every word and pair that is a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"feature": [], "sentence": [], "n_sentences": []}
            for t in texts(b):
                x = bags([t.encode("utf-8", "surrogatepass")])
                sent = np.repeat(np.arange(len(x.start)), np.diff(np.r_[x.start, len(x.word)]))
                h, of = np.concatenate([x.word, x.pair]), np.concatenate([sent, sent])
                k = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                hit = np.flatnonzero(keys[k] == h) if len(keys) else np.empty(0, np.int64)
                out["feature"].append(k[hit].astype(np.int32).tobytes())
                out["sentence"].append(of[hit].astype(np.int32).tobytes())
                out["n_sentences"].append(len(x.start))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "toxic": b.column("toxic"), "n_sentences": pa.array(out["n_sentences"], pa.int32()), **{c: pa.array(out[c], pa.binary()) for c in ("feature", "sentence")}})

    return run


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)`` (null labels or ids don't count; of several
    labels of a document the largest counts).

    At most ``max_toxic`` and ``max_clean`` documents are drawn, those with the least hash of doc_id, and weighted to
    the shares that they were drawn from. Features are counted over the sample by Spark; the driver gets the FEATURES
    that speak most for toxicity or against it (of at least LEAST_DOCS documents) and where they occur.
    """
    spark = docs.sparkSession
    one = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = None
    for y, most in ((1, max_toxic), (0, max_clean)):
        part = one.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        drawn = part if drawn is None else drawn.union(part)
    chosen = spark.createDataFrame([tuple(r) for r in drawn.collect()], "doc_id long, toxic int")
    sample, path = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id"), "toxicity-sample")
    n, pos = sample.agg(F.count("*"), F.sum("toxic")).first()
    keys = np.empty(0, U)
    if pos and pos < n:
        share = F.lit(pos / n)
        counts = sample.mapInArrow(_counted, "feature long, df long, pos long").groupBy("feature").agg(F.sum("df").alias("df"), F.sum("pos").alias("pos")).where(F.col("df") >= LEAST_DOCS)
        z = F.abs((F.col("pos") - F.col("df") * share) / F.sqrt(F.col("df") * share * (1 - share) + 1e-9))
        keys = np.sort(np.array([r.feature for r in counts.orderBy(z.desc(), "feature").limit(FEATURES).collect()], np.int64).view(U))
    table = sample.mapInArrow(_indexed(keys), "doc_id long, toxic int, n_sentences int, feature binary, sentence binary").toArrow()
    drop_path(spark, path)
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "feature", "sentence", "n_sentences", "toxic")), strict=True))
    toxic = np.array([r[-1] for r in rows], np.int64)
    shares = {y: sizes.get(y, 0) / max(1, min(sizes.get(y, 0), most)) for y, most in ((1, max_toxic), (0, max_clean))}
    return train(keys, Sample([np.frombuffer(r[1], np.int32) for r in rows], [np.frombuffer(r[2], np.int32) for r in rows], [r[3] for r in rows], toxic, np.array([shares[int(y)] for y in toxic])))


def _score(model: Model, locate: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in texts(b)]
            score: list[float] = []
            spans: list[list] = []
            for i, j in chunks(raw):
                x = bags(raw[i:j])
                z = model.sentences(x)
                score += model.documents(z, x.owner, j - i).tolist()
                if locate:
                    found: list[list] = [[] for _ in range(j - i)]
                    for k in np.flatnonzero(z >= 0).tolist():
                        found[x.owner[k]].append({"start": int(x.span[k, 0]), "end": int(x.span[k, 1]), "score": float(1 / (1 + np.exp(-z[k])))})
                    spans += found
            cols = {"doc_id": b.column("doc_id").cast(pa.int64()), "score": pa.array(score, pa.float64())}
            if locate:
                cols["offending"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))
            cols["key"] = b.column("key")
            yield pa.RecordBatch.from_pydict(cols)

    return run


HELD_OUT = "coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0, false)"


def score(docs: DataFrame, model: Model, locate: bool = True) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` and, if asked, ``offending``: byte ranges of sentences scored 0.5 or more.

    One row per row of ``docs(doc_id, text)``; other columns are ignored. Null and empty texts have no sentences and
    get the leak's score; a null doc_id is not held out. No shuffle.
    """
    small_batches(docs.sparkSession)
    more = ", offending array<struct<start: long, end: long, score: double>>" if locate else ""
    out = docs.select("doc_id", "text", F.lit(None).cast("int").alias("key")).mapInArrow(_score(model, locate), f"doc_id long, score double{more}, key int")
    return out.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), *(["offending"] if locate else []))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` whose text scores under 0.5, with all their columns; each row is judged by its own text, whatever
    its doc_id. Null and empty texts get the leak's score. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, keep = [t.encode("utf-8", "surrogatepass") for t in texts(b)], []
            for i, j in chunks(raw):
                x = bags(raw[i:j])
                keep += (model.documents(model.sentences(x), x.owner, j - i) < 0.5).tolist()
            yield b.filter(pa.array(keep, pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, locate: bool = True) -> DataFrame:
    """Scores of all documents by a model learnt from the labelled rows that are not held out."""
    return score(docs, fit(docs, labels.where(f"not {HELD_OUT}")), locate)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """``offending``: byte ranges ``start-end`` of the sentences that the score comes from, with commas between."""
    found = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    ranges = F.array_join(F.transform("offending", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", "held_out", "score", "predicted", F.size("offending").cast("long").alias("n_offending"), ranges.alias("offending"))
