"""Least labels of all nodes, cell by cell: a task settles a whole cell of the graph, only labels at borders travel.

A round takes the labels that entered cells, settles every such cell on its own and hands on what leaves it, so the
number of jobs follows the cells that a way crosses, not its arcs.
"""

from __future__ import annotations

from bisect import bisect_right
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopath.plans.materialize import checkpoint, forget

#: nodes of a cell
SIZE = 4096
#: queries that one task settles in one cell
TOGETHER = 64
_DEEPEST = 16


def by_number(nodes: DataFrame, size: int = SIZE) -> DataFrame:
    """``(node, cell)``: ``size`` numbers in a row are a cell. Good where neighbours have near numbers."""
    return nodes.select("node", F.floor(F.col("node") / size).alias("cell"))


def by_place(nodes: DataFrame, size: int = SIZE) -> DataFrame:
    """``(node, cell)`` of ``nodes(node, x, y)``: the largest tiles of halved sides that hold at most ``size`` nodes.

    Nodes of one smallest tile beyond ``size`` are dealt to several cells by hash; those without a place are cells of
    their own.
    """
    placed = nodes.where("abs(x) < 1e300 and abs(y) < 1e300")
    box = placed.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    top = (1 << _DEEPEST) - 1
    unit = lambda c: F.coalesce(F.floor(F.try_divide(F.col(c) - F.col(f"{c}0"), F.col(f"{c}1") - F.col(f"{c}0")) * top), F.lit(0))
    on = placed.crossJoin(F.broadcast(box)).select("node", unit("x").alias("i"), unit("y").alias("j"))
    fine = on.groupBy("i", "j").count()
    levels = fine.select("i", "j", "count", F.explode(F.sequence(F.lit(0), F.lit(_DEEPEST))).alias("deep"))
    side = F.pow(F.lit(2.0), F.lit(_DEEPEST) - F.col("deep"))
    levels = levels.select(F.col("i").alias("fi"), F.col("j").alias("fj"), "count", "deep", F.floor(F.col("i") / side).alias("ti"), F.floor(F.col("j") / side).alias("tj"))
    held = levels.groupBy("deep", "ti", "tj").agg(F.sum("count").alias("n"))
    fits = levels.join(held, ["deep", "ti", "tj"]).where((F.col("n") <= size) | (F.col("deep") == _DEEPEST))
    least = fits.groupBy("fi", "fj").agg(F.min(F.struct("deep", "ti", "tj", "n")).alias("m"))
    packed = F.shiftleft(F.col("m.deep").cast("long"), 2 * _DEEPEST + 2) + F.shiftleft(F.col("m.ti").cast("long"), _DEEPEST + 1) + F.col("m.tj").cast("long")
    chosen = least.select(F.col("fi").alias("i"), F.col("fj").alias("j"), packed.alias("tile"), F.ceil(F.col("m.n") / size).alias("parts"))
    return on.join(chosen, ["i", "j"]).select("node", (F.shiftleft(F.col("tile"), 20) + F.pmod(F.xxhash64("node"), F.col("parts"))).alias("cell"))


def _value(arc, x):
    """Travel time of an arc's knots at x; None outside."""
    t, v = arc[3], arc[4]
    i = bisect_right(t, x)
    if i == 0:
        return None
    if t[i - 1] == x:
        return v[i - 1]
    if i == len(t):
        return None
    return v[i - 1] + (v[i] - v[i - 1]) * (x - t[i - 1]) / (t[i] - t[i - 1])


def _least(cost, arc):
    return cost + arc[3]


def _arrival(cost, arc):
    more = _value(arc, cost)
    return None if more is None else cost + more


def _departure(cost, arc):
    """Minus the latest departure that arrives by minus ``cost``; arcs never let a later departure arrive earlier."""
    t, arrives = arc[3], arc[5]
    i = bisect_right(arrives, -cost)
    if i == 0:
        return None
    if i == len(t):
        return -t[-1]
    return -(t[i - 1] + (-cost - arrives[i - 1]) * (t[i] - t[i - 1]) / (arrives[i] - arrives[i - 1]))


_STEPS = {"least": _least, "arrival": _arrival, "departure": _departure}


def _settle(entered, known, out, barred, limit, step):
    """Labels of a cell's nodes after ``entered`` came in, and the least labels that leave it by node."""
    best, left, heap = dict(known), {}, []
    for node, label in entered:
        if node not in best or label < best[node]:
            best[node] = label
            heap.append((label, node))
    heapify(heap)
    while heap:
        label, node = heappop(heap)
        if best[node] != label:
            continue
        for arc in out.get(node, ()):
            if arc[1] in barred:
                continue
            cost = step(label[0], arc)
            if cost is None or not cost <= limit:
                continue
            new, to, away = (cost, label[1] + 1, arc[1]), arc[0], arc[2]
            if away is None:
                if to not in best or new < best[to]:
                    best[to] = new
                    heappush(heap, (new, to))
            elif to not in left or new < left[to][0]:
                left[to] = new, away
    return best, left


def _task(keys, how):
    step = _STEPS[how]

    def work(labels: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
        out: dict = {}
        for r in arcs.itertuples(index=False):
            away = None if r.home == r.to_cell else r.to_cell
            if how == "least":
                arc = (r.to, r.arc_id, away, r.lb)
            else:
                t, v = list(r.kt), list(r.kv)
                arc = (r.to, r.arc_id, away, t, v, [a + b for a, b in zip(t, v, strict=True)])
            out.setdefault(r.node, []).append(arc)
        cell, rows = labels["cell"].iat[0], []
        for key, own in labels.groupby(keys, sort=False):
            entered, known, barred = [], {}, set()
            for node, none, cost, hops, arc, fresh in zip(own.node, own.node.isna(), own.cost, own.hops, own.arc_id, own.fresh, strict=True):
                if none:
                    barred.add(arc)
                elif fresh:
                    entered.append((int(node), (cost, hops, arc)))
                else:
                    known[int(node)] = cost, hops, arc
            best, left = _settle(entered, known, out, barred, key[-1], step)
            rows += [(*key, n, cell, *label, False) for n, label in best.items()]
            rows += [(*key, n, away, *label, True) for n, (label, away) in left.items()]
        return pd.DataFrame(rows, columns=[*keys, "node", "cell", "cost", "hops", "arc_id", "fresh"])

    return work


def spread(edges: DataFrame, starts: DataFrame, keys: list[str], how: str = "least", forward: bool = True, cells: DataFrame | None = None, without: DataFrame | None = None) -> DataFrame:
    """Least labels ``(*keys, node, cost, hops, arc_id)`` from ``starts(*keys, node, cost, limit)`` up to each limit.

    ``how``: "least" adds the arcs' ``lb``; "arrival" follows their travel functions from departure ``cost``;
    "departure" goes backwards from deadline -``cost``, and costs are minus the latest departures. Ties by hops, then
    by the last arc (-1 at a start). ``cells(node, cell)`` defaults to ``by_number``; nodes that it lacks are cells of
    their own. ``without(query_id, arc_id)`` names arcs that a query may not use. Starts with a null key, node or limit
    have no labels; nodes without arcs keep their own; repeated rows change nothing.

    A task holds the arcs of one cell and the labels of at most about ``TOGETHER`` queries in it; a cell that more
    queries enter is settled by several tasks.
    """
    a, z = ("u", "v") if forward else ("v", "u")
    function = [F.col("lb").cast("double").alias("lb")] if how == "least" else [F.transform("knots", lambda k: k["t"].cast("double")).alias("kt"), F.transform("knots", lambda k: k["v"].cast("double")).alias("kv")]
    arcs = edges.select(F.col(a).cast("long").alias("node"), F.col(z).cast("long").alias("to"), F.col("arc_id").cast("long").alias("arc_id"), *function)
    if cells is None:
        cell_of = lambda df, n, name: df.withColumn(name, F.floor(F.col(n) / SIZE))
    else:
        places = cells.select(F.col("node").cast("long").alias("_n"), F.col("cell").cast("long").alias("_c"))
        cell_of = lambda df, n, name: df.join(places, F.col(n) == F.col("_n"), "left").withColumn(name, F.coalesce("_c", -1 - F.col(n))).drop("_n", "_c")
    arcs = cell_of(cell_of(arcs.where("node is not null and to is not null"), "node", "cell"), "to", "to_cell")
    if cells is not None:
        arcs = checkpoint(arcs)
    group = [*keys, "limit"]
    types = dict(starts.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", `limit` double, node long, cell long, cost double, hops long, arc_id long, fresh boolean"
    first = starts.select(*keys, F.col("limit").cast("double").alias("limit"), F.col("node").cast("long").alias("node"), F.col("cost").cast("double").alias("cost"), F.lit(0).cast("long").alias("hops"), F.lit(-1).cast("long").alias("arc_id"), F.lit(True).alias("fresh")).dropna()
    order = [*group, "node", "cell", "cost", "hops", "arc_id", "fresh"]
    held = checkpoint(cell_of(first, "node", "cell").select(*order))
    while held.where("fresh").limit(1).count():
        known = held.where("not fresh")
        came = held.where("fresh").groupBy(*group, "cell", "node").agg(F.min(F.struct("cost", "hops", "arc_id")).alias("m")).select(*group, "node", "cell", "m.*", F.lit(True).alias("fresh"))
        pairs = came.select(*group, "cell").distinct()
        many = pairs.groupBy("cell").agg(F.ceil(F.count("*") / TOGETHER).alias("_parts"))
        dealt = pairs.join(many, "cell").select(*group, "cell", F.pmod(F.xxhash64(*group), F.col("_parts")).alias("_part"))
        work = known.unionByName(came).join(dealt, [*group, "cell"])
        if without is not None:
            named = without.select("query_id", F.col("arc_id").cast("long").alias("arc_id")).join(arcs.select("arc_id", "cell"), "arc_id").join(dealt, ["query_id", "cell"])
            work = work.unionByName(named.select(*group, "cell", "arc_id", "_part"), allowMissingColumns=True)
        lots = dealt.groupBy("cell", "_part").count().select(F.col("cell").alias("_cell"), F.col("_part").alias("_lot"))
        needed = lots.join(arcs, F.col("_cell") == F.col("cell")).withColumn("home", F.col("cell")).drop("cell")
        settled = work.groupBy("cell", "_part").cogroup(needed.groupBy("_cell", "_lot")).applyInPandas(_task(group, how), schema)
        idle = known.join(pairs, [*group, "cell"], "left_anti")
        new = checkpoint(idle.select(*order).unionByName(settled))
        forget(held)
        held = new
    if cells is not None:
        forget(arcs)
    return held.select(*keys, "node", "cost", "hops", "arc_id")
