"""Fields of raw records as columns: attributes with holes, street codes, schedule times, points and encoded lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronopath.functions.temporal import let

# How raw tables write that an attribute is missing, in lower case; and codes of one-way directions.
MISSING = ("nan", "none", "null")
WITH_CODES, AGAINST_CODES = ("TF", "T", "WITH"), ("FT", "F", "AGAINST")


def known(value: Column) -> Column:
    """Trimmed text, or UNKNOWN where it is null, empty or says that it is missing."""
    text = F.trim(value)
    return F.when(text.isNull() | (text == "") | F.lower(text).isin(*MISSING), "UNKNOWN").otherwise(text)


def turn_by_code(direct: Column, code: Column) -> Column:
    """Degrees between an edge and a street that may be driven as its code says; ``direct`` is the angle as drawn.
    Streets without a code may be driven both ways."""
    c = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    reverse = 180.0 - direct
    return F.when(c.isin(*WITH_CODES), direct).when(c.isin(*AGAINST_CODES), reverse).otherwise(F.least(direct, reverse))


def schedule_time(day: Column, text: Column) -> Column:
    """Moment of a schedule's ``HH:MM[:SS]`` on a service day; hours from 24 on are on days after it. Null where malformed."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: p.try_cast("double"))
    ok = (F.size(parts) >= 2) & F.forall(parts, lambda p: p.isNotNull() & (p >= 0)) & (F.get(parts, F.lit(1)) < 60)
    seconds = F.floor(F.get(parts, F.lit(0))) * 3600 + F.floor(F.get(parts, F.lit(1))) * 60 + F.coalesce(F.floor(F.get(parts, F.lit(2))), F.lit(0))
    return F.when(ok, F.timestamp_seconds(F.unix_timestamp(day.cast("date").cast("timestamp")) + seconds))


def points(text: Column) -> Column:
    """Numbers of a text in pairs, as ``array<struct<x, y>>``; null where their count is odd or under four."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"([-+]?\d+(?:\.\d+)?)"), F.lit(1)), lambda v: v.cast("double"))
    n = F.size(numbers)
    pair = lambda i: F.struct(F.get(numbers, 2 * i).alias("x"), F.get(numbers, 2 * i + 1).alias("y"))
    return F.when((n >= 4) & (n % 2 == 0), F.transform(F.sequence(F.lit(0), F.greatest(F.floor(n / 2).cast("int") - 1, F.lit(0))), pair))


def decode_line(text: Column, digits: int = 5) -> Column:
    """Points ``array<struct<x, y>>`` of an encoded line: differences in groups of five bits, latitude first. Null where
    the text is cut off or holds other characters."""
    groups = F.regexp_extract_all(text, F.lit(r"([_-~]*[?-^])"), F.lit(1))
    low = F.lit(31).cast("long")
    number = lambda g: F.aggregate(F.transform(F.split(g, ""), lambda c: F.ascii(c).cast("long") - 63), F.struct(F.lit(0).cast("long").alias("v"), F.lit(1).cast("long").alias("unit")), lambda s, b: F.struct((s["v"] + b.bitwiseAND(low) * s["unit"]).alias("v"), (s["unit"] * 32).alias("unit")))["v"]
    signed = lambda v: F.when(v % 2 == 1, -((v + 1) / 2).cast("long")).otherwise((v / 2).cast("long"))
    empty = F.array().cast("array<struct<x: bigint, y: bigint>>")
    last = lambda done, c: F.coalesce(F.get(done, F.size(done) - 1)[c], F.lit(0))

    def summed(d: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(d) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.get(d, 2 * i + 1).alias("x"), F.get(d, 2 * i).alias("y")))
        whole = F.aggregate(steps, empty, lambda done, s: F.concat(done, F.array(F.struct(*[(last(done, c) + s[c]).alias(c) for c in "xy"]))))
        return F.when((F.size(d) % 2 == 0) & (F.size(d) > 0), F.transform(whole, lambda p: F.struct((p["x"] / 10**digits).alias("x"), (p["y"] / 10**digits).alias("y"))))

    def line(g: Column) -> Column:
        return F.when(F.length(F.array_join(g, "")) == F.length(text), let(F.transform(F.transform(g, number), signed), summed))

    return let(groups, line)


def encode_line(line: Column, digits: int = 5) -> Column:
    """The text that ``decode_line`` reads, of points rounded to ``digits`` decimals; an empty line is empty."""
    places = F.transform(line, lambda p: F.array(F.round(p["y"] * 10**digits).cast("long"), F.round(p["x"] * 10**digits).cast("long")))

    def code(u: Column, n: Column, i: Column) -> Column:
        return F.char(F.call_function("shiftright", u, i * 5).bitwiseAND(F.lit(31).cast("long")) + F.when(i < n - 1, 32).otherwise(0) + 63)

    def digits_of(u: Column) -> Column:
        return let(F.greatest(F.ceil(F.length(F.bin(u)) / 5), F.lit(1)).cast("int"), lambda n: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: code(u, n, i)), ""))

    def written(v: Column) -> Column:
        return let(v, lambda x: let(F.when(x < 0, -x * 2 - 1).otherwise(x * 2), digits_of))

    def text(whole: Column) -> Column:
        step = lambda p, i: F.concat(*[written(F.get(p, F.lit(k)) - F.coalesce(F.get(F.get(whole, i - 1), F.lit(k)), F.lit(0))) for k in (0, 1)])
        return F.array_join(F.transform(whole, step), "")

    return let(places, text)
