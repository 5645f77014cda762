"""Relations between run records, plans, graph variants and timetables: pairing, merging, matching, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from chronopath.operators.records import beside, percentiles


def matched_pairs(df: DataFrame, units: list[str], method: str, reference, value: str) -> DataFrame:
    """Each method's value beside the reference method's on the same unit: ``(units…, method, value, reference, ratio)``."""
    base = df.where(F.col(method) == reference).select(*units, F.col(value).alias("reference"))
    rest = df.where(F.col(method) != reference).select(*units, method, F.col(value).alias("value"))
    return rest.join(base, units).withColumn("ratio", F.when(F.col("reference") > 0, F.col("value") / F.col("reference")))


def planned(plan: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Every planned run with its record's columns, and whether there is one."""
    return plan.join(records.withColumn("_there", F.lit(True)), keys, "left").withColumn("recorded", F.coalesce("_there", F.lit(False))).drop("_there")


def matched_medians(pairs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Number of paired units and the median of each metric, values that are missing left out."""
    out = pairs.groupBy(*keys).agg(F.count("*").alias("paired_units"))
    for m in metrics:
        out = beside(out, percentiles(pairs, keys, m, between={f"median_{m}": 0.5}), keys)
    return out


def observations(df: DataFrame, keys: list[str], runtime: str, status: str, memory: str) -> DataFrame:
    """Runs of each key: how many, how many were timed, median and 95th rank of time, shares of outcomes, peak memory."""
    share = lambda *s: F.avg(F.col(status).isin(*s).cast("double"))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("observations"), F.count(runtime).alias("timed"),
        share("COMPLETED", "NO_FEASIBLE_PATH").alias("completed"), share("TIMEOUT").alias("timed_out"), share("OUT_OF_MEMORY").alias("out_of_memory"), F.max(memory).alias("peak_memory"),
    )
    return beside(out, percentiles(df, keys, runtime, {"p95_runtime": 0.95}, {"median_runtime": 0.5}), keys).select(*keys, "observations", "timed", "median_runtime", "p95_runtime", "completed", "timed_out", "out_of_memory", "peak_memory")


def by_level(df: DataFrame, level: str, done: Column, late: Column, score: str, base_score: str, travel: str, base_travel: str, runtime: str) -> DataFrame:
    """Case analysis by budget level: counts, scores and travel times over completed runs beside the fastest path's on
    the same runs, gains in percent, quartiles of the time of all runs."""
    of = lambda c: F.avg(F.when(done, F.col(c)))
    out = df.groupBy(level).agg(
        F.count("*").alias("n"), F.count(F.when(done, 1)).alias("n_done"), F.avg(late.cast("double")).alias("timeout_rate"), of(score).alias("score"), of(base_score).alias("base_score"), of(travel).alias("travel"), of(base_travel).alias("base_travel"),
    )
    out = beside(out, percentiles(df, [level], runtime, between={"q1": 0.25, "median": 0.5, "q3": 0.75}), [level])
    gain = lambda a, b: 100 * (F.col(a) - F.col(b)) / F.greatest(F.col(b), F.lit(1e-9))
    return out.withColumn("score_gain", F.col("score") - F.col("base_score")).withColumn("score_gain_percent", gain("score", "base_score")).withColumn("travel_premium_percent", gain("travel", "base_travel"))


def level_change(df: DataFrame, units: list[str], level: str, low, high, done: Column, value: str) -> DataFrame:
    """Units that are complete at both levels: how many, mean change of the value, share that doesn't fall."""
    at = lambda x, name: df.where((F.col(level) == x) & done).select(*units, F.col(value).alias(name))
    both = at(low, "_a").join(at(high, "_b"), units)
    return both.agg(F.count("*").alias("n"), F.avg(F.col("_b") - F.col("_a")).alias("mean_change"), F.avg((F.col("_b") - F.col("_a") >= -1e-9).cast("double")).alias("monotone_share"))


def progress(plan: DataFrame, records: DataFrame, keys: list[str], by: str, status: str) -> DataFrame:
    """Of each group of planned runs: planned, recorded, left, and records of each status."""
    j = planned(plan, records.select(*keys, status), keys)
    return j.groupBy(by).agg(F.count("*").alias("planned"), F.count(status).alias("recorded"), F.count(F.when(~F.col("recorded"), 1)).alias("left_over"), F.count(F.when(F.col(status) == "F", 1)).alias("n_f"), F.count(F.when(F.col(status) == "O", 1)).alias("n_o"), F.count(F.when(F.col(status) == "P", 1)).alias("n_p"))


def merge_reused(raw: DataFrame, reused: DataFrame, key: list[str]) -> DataFrame:
    """Fresh and reused records together with ``origin``; a key that both sides have is an error."""
    both = raw.select(*key).join(reused.select(*key), key, "left_semi").limit(1).collect()
    if both:
        raise ValueError(f"a record is both fresh and reused: {both[0].asDict()}")
    return raw.withColumn("origin", F.lit("FRESH")).unionByName(reused.withColumn("origin", F.lit("REUSED")))


def flatten(df: DataFrame) -> DataFrame:
    """Nested records as one column for each leaf, named by its path with underscores; arrays and maps stay."""
    def leaves(schema: StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema.fields:
            at = (*path, f.name)
            out += leaves(f.dataType, at) if isinstance(f.dataType, StructType) else [F.col(".".join(f"`{p}`" for p in at)).alias("_".join(at))]
        return out

    return df.select(*leaves(df.schema, ()))


def semi_matched(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys).distinct(), keys, "left_semi")


def unmatched(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def to_links(bins: DataFrame, links: DataFrame, key: str, link: str, value: str) -> DataFrame:
    """Observations of bins carried to the links that they map to: ``(link, observations, sources)``."""
    return bins.join(links.select(key, link), key).groupBy(link).agg(F.sum(value).alias("observations"), F.count("*").alias("sources"))


def with_attributes(df: DataFrame, attributes: DataFrame, key: str) -> DataFrame:
    """Left join to attributes that must be unique by key; a repeated key is an error."""
    twice = attributes.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][0]} has more than one row of attributes")
    return df.join(attributes, key, "left")


def allocation(df: DataFrame, keys: list[str], length: str) -> DataFrame:
    """Each row's share of its group's length."""
    total = df.groupBy(*keys).agg(F.sum(length).alias("_t"))
    return df.join(total, keys).withColumn("fraction", F.try_divide(F.col(length), F.col("_t"))).drop("_t")


def study_matrix(axes: list[DataFrame]) -> DataFrame:
    """All combinations of a few axes' values; an axis is a list that a person wrote, of a thousand values at most."""
    out = axes[0].distinct()
    for a in axes[1:]:
        if a.distinct().limit(1001).count() > 1000:
            raise ValueError("an axis of a study has more than a thousand values")
        out = out.crossJoin(F.broadcast(a.distinct()))
    return out


def resolve(df: DataFrame, keys: list[str], choice: str, meets: Column, cost: Column, worth: Column) -> DataFrame:
    """Of each key's settings the cheapest one that meets the bar, or else the one of most worth; ties by the setting."""
    order = F.struct(F.when(meets, 0).otherwise(1).alias("a"), F.when(meets, cost).otherwise(-worth).alias("b"), F.col(choice).alias("c"))
    return df.groupBy(*keys).agg(F.min_by(choice, order).alias("choice"))


def source_diagnostic(df: DataFrame, value: str, kinds: list[str]) -> DataFrame:
    """Rows, distinct values of some columns, share of missing values and their range."""
    return df.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"n_{c}") for c in kinds], F.avg(F.col(value).isNull().cast("double")).alias("missing"), F.min(value).alias("least"), F.max(value).alias("most"))


def score_support(arcs: DataFrame, cell: str, best: str) -> DataFrame:
    """Score-bearing arcs of each cell, 0 where it has none."""
    return arcs.groupBy(cell).agg(F.count(F.when(F.col(best) > 0, 1)).alias("n_support"), F.count("*").alias("n_arcs"), F.min(F.when(F.col(best) > 0, F.col("arc_id"))).alias("first_arc"))


def not_nested(variants: DataFrame) -> DataFrame:
    """``variants(level, arc_id)``: arcs of a level that the next level lacks; nested variants give no rows."""
    levels = variants.select("level").distinct().withColumn("next", F.lead("level").over(Window.partitionBy(F.lit(0)).orderBy("level")))  # a row a level
    up = variants.join(F.broadcast(levels.where("next is not null")), "level")
    return up.join(variants.select(F.col("level").alias("next"), "arc_id"), ["next", "arc_id"], "left_anti").select("level", "next", "arc_id")


def pivot_coverage(paths: DataFrame, pivots: DataFrame, keys: list[str]) -> DataFrame:
    """``paths(keys…, path, covered)`` with the ranks of the pivots on the path added to those covered; ``pivots(keys…, arc_id, rank)``."""
    ranks = pivots.groupBy(*keys).agg(F.collect_list(F.struct("arc_id", "rank")).alias("_p"))  # pivots are few by design
    hit = F.transform(F.filter(F.coalesce("_p", F.array()), lambda p: F.array_contains("path", p["arc_id"])), lambda p: p["rank"])
    return paths.join(ranks, keys, "left").withColumn("covered", F.array_sort(F.array_union("covered", hit))).drop("_p")


def anchors(edges: DataFrame, queries: DataFrame, bounds: DataFrame, scores: DataFrame) -> DataFrame:
    """Relevant anchors: score-bearing arcs that a query can enter in its window, ranked.

    The window of entry is [ts + from_src(u), te + b - lb - to_dst(v)]. Rank by score integral inside it, positive
    time, slack, detour over the direct bound, arc.
    """
    u = bounds.select("query_id", F.col("node").alias("u"), "from_src")
    v = bounds.select("query_id", F.col("node").alias("v"), F.col("to_dst").alias("rest"))
    direct = bounds.join(queries.select("query_id", F.col("src").alias("node")), ["query_id", "node"]).select("query_id", F.col("to_dst").alias("direct"))
    j = edges.where("u <> v").select("arc_id", "u", "v", "lb").join(u, "u").join(v, ["query_id", "v"]).join(queries.select("query_id", "ts", "te", "b"), "query_id").join(direct, "query_id")
    j = j.withColumn("slack", F.col("b") - F.col("from_src") - F.col("lb") - F.col("rest")).withColumn("enter_from", F.col("ts") + F.col("from_src")).withColumn("enter_to", F.col("te") + F.col("b") - F.col("lb") - F.col("rest")).where("slack >= 0 and enter_from <= enter_to")
    part = F.greatest(F.least(F.col("t1"), F.col("enter_to")) - F.greatest(F.col("t0"), F.col("enter_from")), F.lit(0.0))
    x = j.join(scores.where("score > 0").select("arc_id", "t0", "t1", "score"), "arc_id").withColumn("_w", part).where("t0 <= enter_to and t1 > enter_from")
    g = x.groupBy("query_id", "arc_id", "slack", "enter_from", "enter_to", (F.col("b") - F.col("slack") - F.col("direct")).alias("detour")).agg(F.sum(F.col("_w") * F.col("score")).alias("potential"), F.sum("_w").alias("coverage"))
    w = Window.partitionBy("query_id").orderBy(F.col("potential").desc(), F.col("coverage").desc(), F.col("slack").desc(), "detour", "arc_id")
    return g.withColumn("rank", F.row_number().over(w).cast("long"))


def overlapped_bins(trips: DataFrame, keys: list[str], order: str, at: str, start, end, width: float) -> DataFrame:
    """Bins of [start, end) that a trip's first to last instant touches: ``(keys…, bin)``; trips outside give none."""
    span = trips.groupBy(*keys).agg(F.greatest(F.min(at), F.lit(start)).alias("_a"), F.least(F.max(at), F.lit(end)).alias("_z")).where("_a <= _z")
    n = int(-(-(end - start) // width))
    bin_of = lambda c: F.floor((F.col(c) - F.lit(start)) / width).cast("int")
    return span.withColumn("bin", F.explode(F.sequence(F.greatest(bin_of("_a"), F.lit(0)), F.least(bin_of("_z"), F.lit(n - 1))))).drop("_a", "_z")


def first_and_count(df: DataFrame, keys: list[str], order: list[str], group: list[str]) -> DataFrame:
    """First row of each key in order, numbered from 0 within its group as it came."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return first.withColumn("number", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def separated(points: DataFrame, order: list[Column], key: str, x: str, y: str, apart: float, k: int) -> list:
    """Greedy: rows in order, each at least ``apart`` from those taken and with a key of its own, until there are k.

    Rows come to the driver one by one until k are found; what it holds are the k taken.
    """
    taken: list = []
    for r in points.orderBy(*order).toLocalIterator():
        if len(taken) == k:
            break
        if all(r[key] != t[key] and (r[x] - t[x]) ** 2 + (r[y] - t[y]) ** 2 >= apart * apart for t in taken):
            taken.append(r)
    return taken


def disjoint_pairs(pairs: DataFrame, band: str, a: str, b: str, order: list[Column], quota: int) -> DataFrame:
    """Of each band up to ``quota`` pairs that share no end, greedily in order.

    Done in rounds: a pair is taken when it comes first at both of its ends among those left, and then all pairs at
    either end go; that is what going through the order one by one takes. The quota counts in order.
    """
    spark = pairs.sparkSession
    from chronopath.plans.materialize import checkpoint

    left = checkpoint(pairs.withColumn("_o", F.struct(*order)))
    won = None
    while left.limit(1).count():
        ends = left.select(band, F.explode(F.array(a, b)).alias("_e"), "_o").groupBy(band, "_e").agg(F.min("_o").alias("_m"))
        best = left
        for c in (a, b):
            best = best.join(ends.select(band, F.col("_e").alias(c), F.col("_m").alias(f"_{c}")), [band, c])
        new = checkpoint(best.where((F.col("_o") == F.col(f"_{a}")) & (F.col("_o") == F.col(f"_{b}"))).select(*left.columns))
        won = new if won is None else won.unionByName(new)
        gone = new.select(band, F.explode(F.array(a, b)).alias("_e")).distinct()
        for c in (a, b):
            left = left.join(gone.select(band, F.col("_e").alias(c)), [band, c], "left_anti")
        left = checkpoint(left)
    if won is None:
        return spark.createDataFrame([], pairs.schema)
    return won.withColumn("_k", F.row_number().over(Window.partitionBy(band).orderBy("_o"))).where(F.col("_k") <= quota).drop("_k", "_o")


def stable_order(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``place``: each group's candidates ``(path, s, e, arrival, pieces, pivots)`` in one order whatever the
    partitioning: by start, path, end, arrival, score pieces, how many pivots, and the pivots."""
    order = ["s", "path", "e", "arrival", "pieces", F.size("pivots"), F.array_sort("pivots")]
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
