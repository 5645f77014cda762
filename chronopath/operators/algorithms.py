"""Ways to answer profile queries, by name: each takes a graph, queries and options and gives segments.

They differ in which candidates they admit and how they find and assign them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronopath.functions import temporal as T
from chronopath.operators import envelopes as E
from chronopath.operators import frontier as FR
from chronopath.operators import interval_labels as L
from chronopath.operators import paths as P
from chronopath.plans.materialize import checkpoint
from chronopath.plans.temporal_graph import Graph


@dataclass(frozen=True)
class Options:
    """step: minutes of a departure grid; k: paths kept; pivots: score arcs kept; theta, connectors, width, kept: caps of
    the layered search (``frontier.Bounded``); width and rounds: open paths of a query that a round of the anytime search
    extends, and its rounds."""

    step: int = 10
    k: int = 3
    pivots: int = 4
    theta: int = 2
    connectors: int = 8
    width: int = 256
    kept: int = 8
    rounds: int = 100

    def __post_init__(self):
        if self.theta < 0 or min(self.step, self.k, self.pivots, self.connectors, self.width, self.kept, self.rounds) < 1:
            raise ValueError("options must be positive")


def grid(queries: DataFrame, step: int) -> DataFrame:
    """Departures ``(query_id, t)`` from ts on, every ``step`` minutes, and te."""
    steps = F.sequence(F.col("ts").cast("long"), F.col("te").cast("long"), F.lit(step).cast("long"))
    return queries.select("query_id", F.explode(F.array_distinct(F.concat(steps, F.array(F.col("te").cast("long"))))).alias("t"))


def pivots(g: Graph, queries: DataFrame, corridor: DataFrame, limit: int) -> DataFrame:
    """Top score arcs of each query: by best score in the window, share of time with a score, slack, arc.

    Rows ``(query_id, arc_id, best, covered, rank)``; the window is [ts, te + b].
    """
    lo, hi = F.greatest(F.col("t0"), F.col("ts")), F.least(F.col("t1"), F.col("te") + F.col("b"))
    x = corridor.join(g.scores.where("score > 0"), "arc_id").join(queries.select("query_id", "ts", "te", "b"), "query_id").where(lo < hi)
    a = x.groupBy("query_id", "arc_id", "slack").agg(F.max("score").alias("best"), F.sum(hi - lo).cast("double").alias("covered"))
    w = Window.partitionBy("query_id").orderBy(F.col("best").desc(), F.col("covered").desc(), F.col("slack").desc(), "arc_id")
    return a.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit).select("query_id", "arc_id", "best", "covered", "rank")


def cheapest(candidates: DataFrame, k: int) -> DataFrame:
    """The k paths of least lower bound of each query, then fewest arcs, then by arc ids."""
    w = Window.partitionBy("query_id").orderBy("cost", F.size("path"), "path")
    return candidates.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def at_grid(candidates: DataFrame, queries: DataFrame, step: int) -> DataFrame:
    """Feasible candidates at grid departures: ``(query_id, t, path, travel, score)``."""
    at = F.col("t").cast("double")
    x = candidates.join(grid(queries, step), "query_id").join(queries.select("query_id", "b"), "query_id")
    x = x.select("query_id", "t", "b", "path", F.round(T.value_at(F.col("arrival"), at) - at, 9).alias("travel"), T.score_at(F.col("pieces"), at).alias("score"))
    return x.where("travel <= b").drop("b")


def exhaustive(g: Graph, queries: DataFrame, o: Options) -> DataFrame:
    """The exact envelope over all loopless paths within budget."""
    return E.envelope(P.profiles(g.edges, queries), queries)


def all_fastest(g: Graph, queries: DataFrame, o: Options) -> DataFrame:
    """The exact fastest envelope from interval labels; scores don't count, and budgets don't either."""
    return L.all_fastest(g.edges, queries)[0]


def layered(g: Graph, queries: DataFrame, o: Options) -> DataFrame:
    """The envelope over the paths that the layered search finds within its caps."""
    bounds = checkpoint(P.both_bounds(g.edges, queries))
    caps = FR.Bounded(o.theta, o.pivots, o.connectors, o.width, o.kept)
    return E.envelope(FR.layered(g.edges, queries, pivots(g, queries, P.corridor(g.edges, queries, bounds), o.pivots), bounds, caps).candidates, queries)


def exact_labels(g: Graph, queries: DataFrame, o: Options) -> DataFrame:
    """The exact envelope by labels that are dropped where another beats them for good."""
    return E.envelope(FR.labels_exact(g.edges, queries, checkpoint(P.both_bounds(g.edges, queries))), queries)


def first_paths(g: Graph, queries: DataFrame, o: Options) -> DataFrame:
    """The envelope over each query's k cheapest paths."""
    return E.envelope(cheapest(P.profiles(g.edges, queries), o.k), queries)


def anytime(g: Graph, queries: DataFrame, o: Options) -> DataFrame:
    """What a best-first search has found after ``rounds``: a cap on work, not on time, so that answers repeat."""
    *_, committed = FR.anytime(g.edges, queries, checkpoint(P.both_bounds(g.edges, queries)), o.width, o.rounds)
    return E.envelope(committed, queries)


def through_pivots(g: Graph, queries: DataFrame, o: Options) -> DataFrame:
    """The envelope over paths that use one of the query's top score arcs, and the cheapest path."""
    bounds = P.both_bounds(g.edges, queries)
    all_paths = P.profiles(g.edges, queries, bounds)
    top = pivots(g, queries, P.corridor(g.edges, queries, bounds), o.pivots).groupBy("query_id").agg(F.collect_list("arc_id").alias("top"))
    some = all_paths.join(top, "query_id").where(F.arrays_overlap("path", "top")).drop("top")
    return E.envelope(some.unionByName(cheapest(all_paths, 1)).dropDuplicates(["query_id", "path"]), queries)


def sampled(g: Graph, queries: DataFrame, o: Options) -> DataFrame:
    """The best path at each grid departure, kept until the next one; the last departure stands alone."""
    best = at_grid(P.profiles(g.edges, queries), queries, o.step).groupBy("query_id", "t").agg(F.min_by("path", F.struct((-F.col("score")).alias("a"), F.col("travel").alias("b"), F.size("path").alias("c"), F.col("path").alias("d"))).alias("path"))
    x = grid(queries, o.step).join(best, ["query_id", "t"], "left")
    w = Window.partitionBy("query_id").orderBy("t")
    e = F.lead("t").over(w)
    return x.select("query_id", F.col("t").cast("double").alias("s"), F.coalesce(e, F.col("t")).cast("double").alias("e"), F.lit(True).alias("s_inc"), e.isNull().alias("e_inc"), "path")


def interval_best(g: Graph, queries: DataFrame, o: Options) -> DataFrame:
    """The single best departure of the grid: by score, travel, departure, path."""
    x = at_grid(P.profiles(g.edges, queries), queries, o.step)
    m = x.groupBy("query_id").agg(F.min_by(F.struct("t", "path"), F.struct((-F.col("score")).alias("a"), F.col("travel").alias("b"), "t", "path")).alias("m"))
    t = F.col("m.t").cast("double")
    return m.select("query_id", t.alias("s"), t.alias("e"), F.lit(True).alias("s_inc"), F.lit(True).alias("e_inc"), "m.path")


REGISTRY: dict[str, Callable[[Graph, DataFrame, Options], DataFrame]] = {f.__name__: f for f in (exhaustive, all_fastest, layered, exact_labels, first_paths, anytime, through_pivots, sampled, interval_best)}


def answer(name: str, g: Graph, queries: DataFrame, options: Options | None = None) -> DataFrame:
    """Segments by the algorithm of that name; queries that leave the graph's support are answered by no path at all."""
    if name not in REGISTRY:
        raise ValueError(f"unknown algorithm {name}; known: {', '.join(sorted(REGISTRY))}")
    ok = P.horizon_ok(g.edges, queries).where("status = 'OK'").select("query_id")
    return REGISTRY[name](g, queries.join(ok, "query_id", "left_semi"), options or Options())
