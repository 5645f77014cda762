"""Profile relations: pieces of candidate paths, temporal cells, dominance, retention, envelopes and their quality.

A piece is ``(query_id, path, n_edges, s, e, a0, a1, score)``: over [s, e] the path arrives linearly from a0 to a1
and has a constant score. Cells are open intervals (lo < hi) and single points (lo = hi), so winners at one instant
are kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronopath.functions.profiles import within_budget
from chronopath.functions.temporal import abs_linear_integral, canonical

#: Decimals at which travel times are the same: fewer than those of the cells' ends, so that these don't part equal lines.
SAME = 7


def pieces(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Pieces of candidate profiles that keep travel time within the budget."""
    c = candidates.join(queries.select("query_id", "b"), "query_id").select("query_id", "path", "arrival", "pieces", "b")
    parts = c.mapInArrow(within_budget, f"query_id {dict(c.dtypes)['query_id']}, path array<int>, s double, e double, a0 double, a1 double, score bigint")
    return parts.withColumn("n_edges", F.size("path"))


def _travel(t: Column) -> Column:
    return F.when(F.col("s") == F.col("e"), F.col("a0")).otherwise(F.col("a0") + F.try_divide((F.col("a1") - F.col("a0")) * (t - F.col("s")), F.col("e") - F.col("s"))) - t


def cells(parts: DataFrame, queries: DataFrame, tied_only: bool = True) -> DataFrame:
    """``(query_id, lo, hi)``: open cells between all breakpoints, and every breakpoint itself.

    Breakpoints are piece ends and the instants at which two paths have equal travel time — only where their scores
    tie, unless ``tied_only`` is off.
    """
    p = parts.select("query_id", "path", "s", "e", "a0", "a1", "score")
    r = p.select("query_id", *[F.col(c).alias("r_" + c) for c in ("path", "s", "e", "a0", "a1", "score")])
    lo, hi = F.greatest("s", "r_s"), F.least("e", "r_e")
    j = p.join(r, "query_id").where((F.col("path") < F.col("r_path")) & (lo < hi) & (F.col("score") == F.col("r_score") if tied_only else F.lit(True)))
    own = lambda a0, a1, s, e, t: F.col(a0) + F.try_divide((F.col(a1) - F.col(a0)) * (t - F.col(s)), F.col(e) - F.col(s))
    d0 = own("a0", "a1", "s", "e", lo) - own("r_a0", "r_a1", "r_s", "r_e", lo)
    d1 = own("a0", "a1", "s", "e", hi) - own("r_a0", "r_a1", "r_s", "r_e", hi)
    roots = j.where(d0 * d1 < 0).select("query_id", (lo + F.try_divide(d0 * (hi - lo), d0 - d1)).alias("t"))
    marks = parts.select("query_id", F.explode(F.array("s", "e")).alias("t")).union(queries.select("query_id", F.explode(F.array(F.col("ts").cast("double"), F.col("te").cast("double"))).alias("t"))).union(roots)
    marks = marks.withColumn("t", F.round("t", 9)).distinct()
    w = Window.partitionBy("query_id").orderBy("t")
    spans = marks.withColumn("hi", F.lead("t").over(w)).where("hi is not null").select("query_id", F.col("t").alias("lo"), "hi")
    return spans.union(marks.select("query_id", F.col("t").alias("lo"), F.col("t").alias("hi")))


def in_cells(parts: DataFrame, grid: DataFrame) -> DataFrame:
    """Each cell with every path that covers it: travel at the middle and at both ends, and the score inside."""
    mid = (F.col("lo") + F.col("hi")) / 2
    tol = 1e-8
    # A point takes the piece to its right; the last one owns its end.
    covers = F.when(F.col("lo") < F.col("hi"), (F.col("s") <= mid) & (mid <= F.col("e"))).otherwise((F.col("s") - tol <= F.col("lo")) & (F.col("lo") <= F.col("e") + tol))
    j = grid.join(parts, "query_id").where(covers)
    out = j.select("query_id", "lo", "hi", "path", "n_edges", "score", "s", _travel(mid).alias("travel"), _travel(F.col("lo")).alias("travel_lo"), _travel(F.col("hi")).alias("travel_hi"))
    w = Window.partitionBy("query_id", "lo", "hi", "path").orderBy(F.col("s").desc())
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "s")


def winners(covered: DataFrame, grid: DataFrame, fastest: bool = False) -> DataFrame:
    """Best path of each cell, null where none covers it: by score, travel, edges, path; or fastest by travel, edges, path."""
    travel = F.round("travel", 9)
    order = F.struct(travel.alias("a"), F.col("n_edges").alias("b"), F.col("path").alias("c")) if fastest else F.struct((-F.col("score")).alias("z"), travel.alias("a"), F.col("n_edges").alias("b"), F.col("path").alias("c"))
    best = covered.groupBy("query_id", "lo", "hi").agg(F.min_by(F.struct("path", "score", "travel", "travel_lo", "travel_hi"), order).alias("w"))
    return grid.join(best, ["query_id", "lo", "hi"], "left").select("query_id", "lo", "hi", "w.path", "w.score", "w.travel", "w.travel_lo", "w.travel_hi")


def merge_segments(won: DataFrame) -> DataFrame:
    """Maximal runs of cells won by one path: ``(query_id, s, e, s_inc, e_inc, path)``; path null means no path."""
    w = Window.partitionBy("query_id").orderBy("lo", "hi")
    new = (F.row_number().over(w) == 1) | ~F.lag("path").over(w).eqNullSafe(F.col("path"))
    run = won.withColumn("_n", new.cast("int")).withColumn("_run", F.sum("_n").over(w))
    first, last = F.min(F.struct("lo", "hi")), F.max(F.struct("lo", "hi"))
    out = run.groupBy("query_id", "_run").agg(F.first("path").alias("path"), first.alias("a"), last.alias("z"))
    return out.select("query_id", F.col("a.lo").alias("s"), F.col("z.hi").alias("e"), (F.col("a.lo") == F.col("a.hi")).alias("s_inc"), (F.col("z.lo") == F.col("z.hi")).alias("e_inc"), "path")


def envelope(candidates: DataFrame, queries: DataFrame, fastest: bool = False) -> DataFrame:
    """Segments of each query's best path over its departures."""
    parts = pieces(candidates, queries)
    grid = cells(parts, queries, tied_only=not fastest)
    return merge_segments(winners(in_cells(parts, grid), grid, fastest))


def at_points(segments: DataFrame, points: DataFrame) -> DataFrame:
    """Segment of each point ``(query_id, t)``."""
    hit = (F.col("s") < F.col("t")) & (F.col("t") < F.col("e")) | (F.col("t") == F.col("s")) & F.col("s_inc") | (F.col("t") == F.col("e")) & F.col("e_inc")
    return points.join(segments, "query_id").where(hit).select("query_id", "t", "path")


def distinct_candidates(candidates: DataFrame) -> DataFrame:
    """Without candidates that agree in query, path, domain, arrival and score; the columns decide, not their order."""
    keys = [c for c in ("query_id", "path", "s", "e", "arrival", "pieces", "a0", "a1", "score") if c in candidates.columns]
    return candidates.dropDuplicates(keys)


def undominated(covered: DataFrame) -> DataFrame:
    """Paths of each cell that no other beats safely: equal arrival, at least the score, fewer edges or smaller path.

    Paths with different arrivals never dominate each other, however early they are. For whole paths only; those still
    to be extended go by ``open_undominated``.
    """
    w = Window.partitionBy("query_id", "lo", "hi", F.round("travel_lo", SAME), F.round("travel_hi", SAME)).orderBy(F.col("score").desc(), "n_edges", "path")
    return covered.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def open_undominated(covered: DataFrame, nodes: DataFrame) -> DataFrame:
    """Paths of each cell that no other beats wherever both can still go: equal arrival, at least the score (the same
    score: fewer edges, then the smaller path), and no node that the beaten one has not visited as well.

    ``nodes(query_id, path, nodes)`` tells the nodes of each path; pivots count by being part of ``query_id``, or are
    nodes' arcs that both have. Paths meet by cell and arrival only. Beating is transitive, so all that are beaten go at
    once.
    """
    key = ["query_id", "lo", "hi", "_a", "_z"]
    one = covered.withColumn("_a", F.round("travel_lo", SAME)).withColumn("_z", F.round("travel_hi", SAME)).join(nodes, ["query_id", "path"])
    other = one.select(*key, F.col("path").alias("o_path"), F.col("score").alias("o_score"), F.col("n_edges").alias("o_edges"), F.col("nodes").alias("o_nodes"))
    better = (F.col("o_score") > F.col("score")) | ((F.col("o_score") == F.col("score")) & (F.struct("o_edges", "o_path") < F.struct("n_edges", "path")))
    beaten = one.join(other, key).where((F.col("path") != F.col("o_path")) & better & (F.size(F.array_except("o_nodes", "nodes")) == 0)).select("query_id", "lo", "hi", "path").distinct()
    return one.join(beaten, ["query_id", "lo", "hi", "path"], "left_anti").drop("_a", "_z", "nodes")


def cell_integrals(covered: DataFrame, queries: DataFrame) -> DataFrame:
    """``covered`` with what retention compares: average travel time over the cell (trapezoid), least slack against the
    budget, the time that the path covers in all its cells, and how many inner vertices it has. Queries ``(query_id, b)``."""
    total = covered.groupBy("query_id", "path").agg(F.sum(F.col("hi") - F.col("lo")).alias("coverage"))
    x = covered.join(total, ["query_id", "path"]).join(queries.select("query_id", "b"), "query_id")
    return x.withColumn("avg_travel", (F.col("travel_lo") + F.col("travel_hi")) / 2).withColumn("min_slack", F.col("b") - F.greatest("travel_lo", "travel_hi")).withColumn("inner", F.greatest(F.col("n_edges") - 1, F.lit(0))).drop("b")


def retain(covered: DataFrame, k: int) -> DataFrame:
    """At most k paths of each cell, from ``cell_integrals``: champion, earliest, widest coverage, fewest inner vertices,
    then the best of the rest; ``role`` 0 to 4. Cells with k paths or fewer keep them all.

    Orders: champion by score, travel at the middle; earliest by average travel, score; coverage by coverage, score,
    average travel; fewest by inner vertices, average travel, score; the rest by score, average travel, slack, coverage,
    inner vertices. Ties in all go to fewer edges, then the smaller path.
    """
    cell = ["query_id", "lo", "hi"]
    by = lambda *o: F.row_number().over(Window.partitionBy(*cell).orderBy(*o, "n_edges", "path"))
    score, early = F.col("score").desc(), F.round("avg_travel", 9)
    ranks = [by(score, F.round("travel", 9)), by(early, score), by(F.col("coverage").desc(), score, early), by("inner", early, score)]
    ranked = covered.withColumns({f"_o{i}": r for i, r in enumerate(ranks)}).withColumn("_fill", by(score, early, F.col("min_slack").desc(), F.col("coverage").desc(), "inner"))
    role = F.lit(4)
    for i in (3, 2, 1, 0):
        role = F.when(F.col(f"_o{i}") == 1, i).otherwise(role)
    kept = ranked.withColumn("role", role).withColumn("_k", F.row_number().over(Window.partitionBy(*cell).orderBy("role", "_fill")))
    return kept.where(F.col("_k") <= k).drop("_fill", "_k", *[f"_o{i}" for i in range(4)])


def compress(covered: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Frontier compression of whole paths: dominated ones go, then each cell keeps k; ``(query_id, path, s, e, role)`` are
    the maximal runs of cells in which a path is kept, with the least of its roles."""
    kept = retain(cell_integrals(undominated(covered), queries), k)
    w = Window.partitionBy("query_id", "path").orderBy("lo", "hi")
    runs = kept.withColumn("_n", (F.coalesce(F.lag("hi").over(w) < F.col("lo"), F.lit(True))).cast("int")).withColumn("_run", F.sum("_n").over(w))
    return runs.groupBy("query_id", "path", "_run").agg(F.min("lo").alias("s"), F.max("hi").alias("e"), F.min("role").alias("role")).drop("_run")


def metrics(won: DataFrame) -> DataFrame:
    """What each query's winners amount to: measures with and without a path, coverage, segments, paths, changes,
    lengths, averages over the time that has a path, best score. Points count only for the best score and for a query
    whose whole departure range is one point."""
    width, found = F.col("hi") - F.col("lo"), F.col("path").isNotNull()
    one = won.groupBy("query_id").agg(
        F.sum(width).alias("_t"), F.sum(F.when(found, width).otherwise(0.0)).alias("_c"), F.max(found).alias("feasible"), F.count_distinct("path").alias("n_paths"),
        F.sum(F.when(found, F.col("score") * width)).alias("_s"), F.sum(F.when(found, (F.col("travel_lo") + F.col("travel_hi")) / 2 * width)).alias("_v"), F.max(F.when(found, F.col("score"))).alias("best_score"),
    )
    long = F.col("e") - F.col("s")
    two = merge_segments(won).groupBy("query_id").agg(F.count("*").alias("n_segments"), F.coalesce(F.min(F.when(long > 0, long)), F.lit(0.0)).alias("_min"))
    return one.join(two, "query_id").select(
        "query_id", "feasible", F.round("_c", 6).alias("covered"), F.round(F.col("_t") - F.col("_c"), 6).alias("uncovered"), F.round(F.when(F.col("_t") == 0, F.col("feasible").cast("double")).otherwise(F.try_divide("_c", "_t")), 6).alias("coverage"),
        "n_segments", "n_paths", (F.col("n_segments") - 1).alias("n_changes"), F.round(F.col("_t") / F.col("n_segments"), 6).alias("avg_length"), F.round("_min", 6).alias("min_length"),
        F.round(F.try_divide("_s", "_c"), 6).alias("avg_score"), F.round(F.try_divide("_v", "_c"), 6).alias("avg_travel"), "best_score",
    )


def quality(won: DataFrame, reference: DataFrame) -> DataFrame:
    """How a candidate's winners compare with a reference's over the same departures, cell by common cell.

    Both sides cover each query's range without gaps (path null: none). Cells meet by one sweep over both sides'
    borders. Scores are compared where the reference has a path (the candidate counts 0 where it has none): regret is
    what the reference scores more, over the reference's score (at least 1); gaps are absolute. Travel times are
    compared where both have a path and equal scores. Breakpoints are the starts of segments but the first.
    """
    columns = ["path", "score", "travel_lo", "travel_hi", "lo", "hi"]
    w = Window.partitionBy("query_id").orderBy("t")
    filled = w.rowsBetween(Window.unboundedPreceding, 0)
    marks = None
    for i, side in enumerate((won, reference)):
        one = side.where("lo < hi").select("query_id", F.col("lo").alias("t"), "hi", *[F.struct(*columns).alias("_" + "ab"[k]) if k == i else F.lit(None).alias("_" + "ab"[k]) for k in (0, 1)])
        marks = one if marks is None else marks.unionByName(one)
    swept = marks.groupBy("query_id", "t").agg(F.max("hi").alias("hi"), F.first("_a", ignorenulls=True).alias("_a"), F.first("_b", ignorenulls=True).alias("_b"))
    swept = swept.withColumn("a", F.last("_a", ignorenulls=True).over(filled)).withColumn("b", F.last("_b", ignorenulls=True).over(filled)).withColumn("z", F.coalesce(F.lead("t").over(w), "hi"))
    at = lambda s, t: F.col(f"{s}.travel_lo") + F.try_divide((F.col(f"{s}.travel_hi") - F.col(f"{s}.travel_lo")) * (F.col(t) - F.col(f"{s}.lo")), F.col(f"{s}.hi") - F.col(f"{s}.lo"))
    x = swept.select(
        "query_id", "t", "z", (F.col("z") - F.col("t")).alias("w"), F.col("a.path").isNotNull().alias("fa"), F.col("b.path").isNotNull().alias("fb"), F.col("a.path").eqNullSafe(F.col("b.path")).alias("same"),
        F.col("b.score").alias("rs"), F.when(F.col("a.path").isNotNull(), F.col("a.score")).otherwise(0).alias("cs"), (at("a", "t") - at("b", "t")).alias("d0"), (at("a", "z") - at("b", "z")).alias("d1"),
    ).withColumn("gap", F.abs(F.col("rs") - F.col("cs")))
    obs, tie = F.col("fb"), F.col("fb") & F.col("fa") & (F.col("rs") == F.col("cs"))
    on = lambda c, v: F.sum(F.when(c, v).otherwise(0.0))
    sums = x.groupBy("query_id").agg(
        F.sum("w").alias("_t"), on(F.col("same"), F.col("w")).alias("_ag"), on(F.col("fa") != F.col("fb"), F.col("w")).alias("_fd"), on(obs, F.col("w")).alias("_ob"), on(tie, F.col("w")).alias("_sa"),
        on(obs, F.greatest(F.col("rs") - F.col("cs"), F.lit(0)) * F.col("w")).alias("_rn"), on(obs, F.greatest(F.col("rs"), F.lit(1)) * F.col("w")).alias("_rd"), on(obs, F.col("gap") * F.col("w")).alias("_ga"),
        F.max(F.when(obs, F.col("gap"))).alias("max_gap"), on(tie, abs_linear_integral(F.col("d0"), F.col("d1"), F.col("w"))).alias("_tg"),
    )
    gaps = x.where("fb").groupBy("query_id", "gap").agg(F.sum("w").alias("_w")).withColumn("_c", F.sum("_w").over(Window.partitionBy("query_id").orderBy("gap"))).withColumn("_o", F.sum("_w").over(Window.partitionBy("query_id")))
    p95 = gaps.where(F.col("_c") >= 0.95 * F.col("_o") - 1e-9).groupBy("query_id").agg(F.min("gap").alias("p95_gap"))
    starts = lambda side: merge_segments(side).withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("s", "e"))).where("_r > 1").select("query_id", canonical(F.col("s")).alias("s")).distinct()
    breaks = starts(won).withColumn("a", F.lit(1)).join(starts(reference).withColumn("b", F.lit(1)), ["query_id", "s"], "full").groupBy("query_id").agg(F.count("a").alias("_na"), F.count("b").alias("_nb"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("_nc"))
    out = sums.join(p95, "query_id", "left").join(breaks, "query_id", "left").fillna(0, ["_na", "_nb", "_nc"])
    share = lambda a, b, other: F.round(F.coalesce(F.try_divide(a, b), F.lit(other)), 6)
    return out.select(
        "query_id", share("_ag", "_t", 0.0).alias("path_agreement"), share("_sa", "_ob", 1.0).alias("score_agreement"), share("_fd", "_t", 0.0).alias("feasibility_disagreement"),
        share("_nc", "_na", 1.0).alias("breakpoint_precision"), share("_nc", "_nb", 1.0).alias("breakpoint_recall"), ((F.col("_na") == F.col("_nc")) & (F.col("_nb") == F.col("_nc"))).alias("same_breakpoints"),
        share("_rn", "_rd", 0.0).alias("score_regret"), F.round(100 * F.coalesce(F.try_divide("_rn", "_rd"), F.lit(0.0)), 6).alias("score_gap_percent"), F.round(F.try_divide("_ga", "_ob"), 6).alias("mean_gap"), "max_gap", "p95_gap",
        F.round(F.try_divide("_tg", "_sa"), 6).alias("tie_travel_gap"), (F.col("_nb") - F.col("_nc")).alias("missed_switches"),
    )
