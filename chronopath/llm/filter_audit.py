"""Filter interaction audit: how five document filters overlap, and what each removes in every order of applying them.

Expressions give each document a mask of the filters that it fails; a grouping by text finds the smallest doc_id that
holds it. Documents then count in cells, 32 at most a part, and all orders are worked out from the cells alone: texts
are read once and only digests of them are shuffled.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
COPY = 16  # the bit of filter E, which needs the whole table


def text_filters(text: Column, words: Column) -> list[Column]:
    """Failure conditions of A to D for a text and the array of its words."""
    n = F.size(words)
    return [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text), text.rlike("[#$%&*|]")]


def masks(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, digest, mask)`` of every row: bits of A to D, and SHA-256 of the whole text."""
    text = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    split = text.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_filters(F.col("text"), F.col("words")))]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    return split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents by part and five-bit mask, with the labels among them."""
    wanted = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = masks(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(wanted, "doc_id", "left").na.fill(0, ["good", "toxic"])
    # Copies of a text are counted before they meet: a row for each part and labels, however many copies there are.
    text = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))), F.lit(0)).alias("with_id"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least")
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    copies = F.col("with_id") - F.when(F.col("least") == first, F.col("n_least")).otherwise(0)
    both = text.withColumn("copies", copies).select("part", "good", "toxic", F.explode(F.array(F.struct("mask", (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), F.col("copies").alias("n")))).alias("c"))
    return both.where("c.n > 0").groupBy("part", "c.mask").agg(F.sum("c.n").alias("n"), F.sum(F.expr("c.n * good")).alias("good"), F.sum(F.expr("c.n * toxic")).alias("toxic"))


def all_orders(counted: DataFrame) -> DataFrame:
    """Per part, order and step, what the step's filter does, from cells of ``(part, mask, n, good, toxic)``."""
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = parts.select("part", "cells", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    bit = f"shiftleft(1, instr('{LETTERS}', substring(filter_order, {{}}, 1)) - 1)"
    steps = steps.withColumns({"filter": F.expr("substring(filter_order, step, 1)"), "bit": F.expr(bit.format("step")), "before": F.expr(f"aggregate(filter(sequence(1, {len(LETTERS)}), i -> i < step), 0, (m, i) -> m | {bit.format('i')})")})

    def total(field: str, where: str) -> Column:
        return F.expr(f"aggregate(cells, 0L, (s, c) -> s + if({where}, c.{field}, 0L))")

    here, fails = "(c.mask & before) = 0 AND (c.mask & bit) <> 0", "(c.mask & bit) <> 0"
    out = steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "filter",
        total("n", "(c.mask & (before | bit)) = 0").alias("kept"), total("n", here).alias("removed"), total("n", f"{fails} AND (c.mask & before) <> 0").alias("redundant"),
        total("n", "c.mask = bit").alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))  # 120 rows


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``.

    ``docs`` needs doc_id, text and lang, ``labels`` doc_id, quality and toxic; other columns are ignored. Null texts
    and languages are empty ones. Repeated rows count each. A row without a doc_id is no copy of another and makes none;
    rows of one doc_id are no copies of each other. Several labels of a doc_id count as one that marks what any marks.
    No documents give no rows. Very long texts are whole, one at a time in a task.
    """
    return all_orders(cells(docs, labels))


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS f, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
o AS (SELECT '' AS o UNION ALL SELECT o || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
s AS (SELECT o AS filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(o) = 5),
e AS (SELECT part, filter_order, step, n, good, toxic, substring(filter_order, step, 1) AS filter, f[ascii(substring(filter_order, step, 1)) - 64] AS fails, len(list_filter(range(1, step), lambda i: f[ascii(substring(filter_order, i, 1)) - 64])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS k FROM c, s),
r AS (SELECT part, filter_order, step, filter, sum(n) FILTER (NOT gone AND NOT fails) AS kept, sum(n) FILTER (fails AND NOT gone) AS removed, sum(n) FILTER (fails AND gone) AS redundant, sum(n) FILTER (fails AND k = 1) AS unique_fails, sum(good) FILTER (fails AND NOT gone) AS good_lost, sum(toxic) FILTER (fails AND NOT gone) AS toxic_lost FROM e GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r"""
