"""A training corpus from raw documents: five filtering and coding stages, each over all that its predecessor kept.

Part of the training-data subpackage; run by ``run(spark, sf_dir)`` or stage by stage through ``STAGES``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopath.llm.bpe import encode_decode
from chronopath.llm.common import drop_path, forget_shuffles, materialize, shuffle_parts
from chronopath.llm.mixing import draw_to_targets
from chronopath.llm.ngram_join import jaccard_classes
from chronopath.llm.suffix_dedup import repeated_spans
from chronopath.llm.toxicity import clean, fit

KEPT_PART = 0.5  # of the tokens that reach the mixing stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores under 0.5 stay, each judged by its own text. The model learns from the labels of the raw
    table (rows of a doc_id that has several texts all carry its label); null and empty texts stay, as does every row
    where no label marks a toxic text."""
    return clean(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number ``_row`` for each (doc_id, text), in the order of doc_id, null last: their own doc_id
    where that tells all rows apart."""
    if not docs.where("doc_id is null").limit(1).count() and not docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return docs.withColumn("_row", F.col("doc_id").cast("long"))
    keys = {"_i": F.col("doc_id").cast("long"), "_a": F.xxhash64("text"), "_b": F.xxhash64(F.lit(11), "text"), "_n": F.col("text").isNull()}
    keyed = docs.withColumns(keys)
    order = [F.col("_i").asc_nulls_last(), "_a", "_b", "_n"]
    ids = keyed.select(*keys).distinct().repartitionByRange(shuffle_parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    ids, ids_path = materialize(ids.withColumn("_row", F.monotonically_increasing_id()).withColumnsRenamed({k: "r" + k for k in keys}), "pipeline-rows")
    same = F.col("_i").eqNullSafe(F.col("r_i")) & (F.col("_a") == F.col("r_a")) & (F.col("_b") == F.col("r_b")) & (F.col("_n") == F.col("r_n"))
    out, _ = materialize(keyed.join(ids, same).select(*docs.columns, "_row").dropDuplicates(["_row"]), "pipeline-numbered")
    drop_path(docs.sparkSession, ids_path)
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingle sets are linked at Jaccard 0.8 the smallest doc_id stays.

    Rows with the same doc_id and text are one document. Of rows without a doc_id or with one that other texts share,
    each text is a document of its own, after those with smaller ids (null last). Texts without words link with nothing
    and stay.
    """
    rows = _numbered(docs)
    kept = jaccard_classes(rows.select(F.col("_row").alias("doc_id"), "text"), width=5, num=80, den=100).where("doc_id = component_id").select(F.col("doc_id").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that occur elsewhere are cut out; documents without any text left go.

    Characters that a cut splits go with it. A null text becomes empty and, like texts that were empty, stays; n_chars
    is counted anew where something was cut. Rows are told apart by their texts alone, so null and repeated ids and
    other columns pass unchanged.
    """
    kept = repeated_spans(docs, keep_text=True)
    left = kept.withColumn("text", F.col("kept")).where("n_removed = 0 or length(trim(text)) > 0")
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the probabilities that bring sources, languages and topics to their targets.

    Null sources and languages are values of their own; draws depend on doc_id (null: one draw for all such rows).
    """
    return draw_to_targets(docs, part=KEPT_PART)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row that is left, and digests of what they decode to; null and empty texts have no ids."""
    return encode_decode(docs, with_ids=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", toxicity), ("ngram_jaccard_join", near_duplicates), ("suffix_array_dedup", repeats), ("mixing", mixing), ("bpe", tokens)]

#: Stages 1, 2 and 4 learn or iterate, which one SQL statement can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            drop_path(spark, before)
        before = path
        forget_shuffles(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
