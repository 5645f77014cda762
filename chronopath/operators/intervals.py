"""Interval sets as rows ``(keys…, s, e, s_inc, e_inc)`` with endpoint ownership.

Every operator partitions by its keys; windows and joins shuffle on the keys alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _alive(df: DataFrame) -> DataFrame:
    return df.where((F.col("s") < F.col("e")) | ((F.col("s") == F.col("e")) & F.col("s_inc") & F.col("e_inc")))


def _size(s: str, e: str):
    """Class of an interval's length, in powers of eight, and no finer than its distance from zero allows to number."""
    n, far = (F.col(e) - F.col(s)).cast("double"), F.greatest(F.abs(F.col(s)), F.abs(F.col(e))).cast("double")
    log = lambda x: F.when(x > 0, F.log(x) / F.log(F.lit(8.0)))
    return F.coalesce(F.greatest(F.floor(log(n)), F.ceil(log(far)) - 16), F.lit(0)).cast("int")


def _stretch(column: str):
    """The stretch of a class's width in which a point lies."""
    return F.floor(F.col(column) / F.pow(F.lit(8.0), F.col("_c") + 1))


def _sized(df: DataFrame, s: str = "s", e: str = "e") -> DataFrame:
    return df.withColumn("_c", _size(s, e)).withColumn("_q", F.explode(F.sequence(_stretch(s), _stretch(e))))


def _sizes(df: DataFrame, s: str = "s", e: str = "e") -> DataFrame:
    """One row: the classes of ``df``'s lengths, at most some 700."""
    return df.agg(F.collect_set(_size(s, e)).alias("_cs"))


def _meeting(a: DataFrame, r: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of a's rows (s, e) and r's (r_s, r_e) of a key that touch.

    A pair meets in the class of the longer one, in a stretch of time not much longer than that: an interval is dealt
    to the stretches of its own class, and to those of every longer class that the other side holds, one or two each.
    So long and short intervals may be mixed; a pair counts in the first stretch that both reach.
    """
    def dealt(x, s, e, own, others):
        longer = F.filter("_cs", lambda c: c > F.col(own))
        on = x.withColumn(own, _size(s, e)).crossJoin(F.broadcast(others)).withColumn("_c", F.explode(F.concat(F.array(own), longer))).drop("_cs")
        return on.withColumn("_q", F.explode(F.sequence(_stretch(s), _stretch(e))))

    left = dealt(a, "s", "e", "_own", _sizes(r, "r_s", "r_e"))
    right = dealt(r, "r_s", "r_e", "_r_own", _sizes(a))
    first = F.greatest(_stretch("s"), _stretch("r_s"))
    j = left.join(right, [*keys, "_c", "_q"]).where((F.col("_c") == F.greatest("_own", "_r_own")) & (F.col("_q") == first))
    return j.where("s <= r_e and r_s <= e").drop("_c", "_q", "_own", "_r_own")


def _points(points: DataFrame, column: str, df: DataFrame) -> DataFrame:
    """Points with their stretch in every class of ``df``'s lengths; points farther out than all intervals have none."""
    far = df.agg(F.collect_set(_size("s", "e")).alias("_cs"), F.max(F.greatest(F.abs("s"), F.abs("e"))).alias("_far"))
    near = points.crossJoin(F.broadcast(far)).where(F.abs(F.col(column)) <= F.col("_far")).withColumn("_c", F.explode("_cs")).drop("_cs", "_far")
    return near.where(F.abs(F.col(column)) < F.pow(F.lit(8.0), F.col("_c") + 18)).withColumn("_q", _stretch(column))


def merge(df: DataFrame, keys: list[str]) -> DataFrame:
    """Union into disjoint intervals; touching ones join where either side owns the point."""
    w = Window.partitionBy(*keys).orderBy("s", F.col("s_inc").desc(), "e", "e_inc")
    before = F.max(F.struct("e", "e_inc")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = before.isNull() | (F.col("s") > before["e"]) | ((F.col("s") == before["e"]) & ~F.col("s_inc") & ~before["e_inc"])
    isle = _alive(df).withColumn("_new", starts.cast("int")).withColumn("_isle", F.sum("_new").over(w))
    out = isle.groupBy(*keys, "_isle").agg(F.min(F.struct("s", (~F.col("s_inc")).alias("open"))).alias("a"), F.max(F.struct("e", "e_inc")).alias("b"))
    return out.select(*keys, F.col("a.s").alias("s"), F.col("b.e").alias("e"), (~F.col("a.open")).alias("s_inc"), F.col("b.e_inc").alias("e_inc"))


def intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairwise intersections of a key's intervals; equal ends are owned if both own them."""
    r = b.select(*keys, *[F.col(c).alias("r_" + c) for c in ("s", "e", "s_inc", "e_inc")])
    j = _meeting(a, r, keys)
    s_inc = F.when(F.col("s") == F.col("r_s"), F.col("s_inc") & F.col("r_s_inc")).when(F.col("s") > F.col("r_s"), F.col("s_inc")).otherwise(F.col("r_s_inc"))
    e_inc = F.when(F.col("e") == F.col("r_e"), F.col("e_inc") & F.col("r_e_inc")).when(F.col("e") < F.col("r_e"), F.col("e_inc")).otherwise(F.col("r_e_inc"))
    rest = [c for c in a.columns if c not in (*keys, "s", "e", "s_inc", "e_inc")]
    return _alive(j.select(*keys, *rest, F.greatest("s", "r_s").alias("s"), F.least("e", "r_e").alias("e"), s_inc.alias("s_inc"), e_inc.alias("e_inc")))


def subtract(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """What of a's disjoint intervals b doesn't cover; cut points change owner."""
    cuts = merge(b, keys).select(*keys, *[F.col(c).alias("r_" + c) for c in ("s", "e", "s_inc", "e_inc")])
    own = [*keys, "s", "e", "s_inc", "e_inc"]
    hits = _meeting(a, cuts, keys)
    w = Window.partitionBy(*own).orderBy("r_s")
    prev_e, prev_inc = F.lag("r_e").over(w), F.lag("r_e_inc").over(w)
    # A cut at an interval's own end leaves the point only to an interval that owned it.
    left = lambda at, inc: F.when(at == F.col("s"), ~inc & F.col("s_inc")).otherwise(~inc)
    right = F.when(F.col("r_s") == F.col("e"), ~F.col("r_s_inc") & F.col("e_inc")).otherwise(~F.col("r_s_inc"))
    gaps = hits.withColumn("_pe", prev_e).withColumn("_pi", prev_inc).select(*keys, F.coalesce("_pe", "s").alias("s2"), F.col("r_s").alias("e2"), F.coalesce(left(F.col("_pe"), F.col("_pi")), F.col("s_inc")).alias("si"), right.alias("ei"))
    tail = hits.groupBy(*own).agg(F.max(F.struct("r_e", "r_e_inc")).alias("m")).select(*keys, F.col("m.r_e").alias("s2"), F.col("e").alias("e2"), left(F.col("m.r_e"), F.col("m.r_e_inc")).alias("si"), F.col("e_inc").alias("ei"))
    whole = a.join(hits.select(*own).distinct(), own, "left_anti").select(*keys, F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("s_inc").alias("si"), F.col("e_inc").alias("ei"))
    out = gaps.union(tail).union(whole)
    return _alive(out.select(*keys, F.col("s2").alias("s"), F.col("e2").alias("e"), F.col("si").alias("s_inc"), F.col("ei").alias("e_inc")))


def split(df: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """Cells [a, b) of each interval between cuts strictly inside it; ``cuts(keys…, cut)``.

    The first cell keeps the interval's left flag, the last its right one. Cuts come one row each through a window, so
    no key's cuts are gathered in one value.
    """
    own = [c for c in df.columns]
    inside = _sized(df).join(_points(cuts.distinct(), "cut", df), [*keys, "_c", "_q"]).where("s < cut and cut < e").select(*own, F.col("cut").alias("_at"), F.lit(True).alias("_at_inc"))
    marks = df.select(*own, F.col("s").alias("_at"), F.col("s_inc").alias("_at_inc")).union(inside)
    w = Window.partitionBy(*own).orderBy("_at")
    cell = marks.withColumn("_to", F.lead("_at").over(w)).select(*[c for c in own if c not in ("s", "e", "s_inc", "e_inc")], F.col("_at").alias("s"), F.coalesce("_to", "e").alias("e"), F.col("_at_inc").alias("s_inc"), F.when(F.col("_to").isNull(), F.col("e_inc")).otherwise(F.lit(False)).alias("e_inc"))
    return _alive(cell)


def contains(df: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Points ``(keys…, t)`` that lie in some interval of their key."""
    hit = (F.col("s") < F.col("t")) & (F.col("t") < F.col("e")) | (F.col("t") == F.col("s")) & F.col("s_inc") | (F.col("t") == F.col("e")) & F.col("e_inc")
    p = _points(points.select(*[F.col(k).alias("_" + k) for k in keys], "t"), "t", df).withColumnRenamed("_c", "_pc").withColumnRenamed("_q", "_pq")
    cond = (F.col("_pc") == F.col("_c")) & (F.col("_pq") == F.col("_q"))
    for k in keys:
        cond &= F.col("_" + k) == F.col(k)
    found = p.join(_sized(df), cond & hit).select(*[F.col("_" + k).alias(k) for k in keys], "t").distinct()
    return points.join(found, [*keys, "t"], "left_semi").select(*keys, "t")


def integer_points(df: DataFrame) -> DataFrame:
    """Integers in each interval, one row each."""
    lo = F.when((F.ceil("s") == F.col("s")) & ~F.col("s_inc"), F.ceil("s") + 1).otherwise(F.ceil("s")).cast("long")
    hi = F.when((F.floor("e") == F.col("e")) & ~F.col("e_inc"), F.floor("e") - 1).otherwise(F.floor("e")).cast("long")
    rest = [c for c in df.columns if c not in ("s", "e", "s_inc", "e_inc")]
    return df.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi").select(*rest, F.explode(F.sequence("_lo", "_hi")).alias("t"))


def islands(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal values in order (null equals null): rows ``(keys…, value, first, last, n)``."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = ~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1)
    runs = df.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(*keys, "_run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")
