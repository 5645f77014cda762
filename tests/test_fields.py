"""Fields of raw records: known values, holes, malformed texts."""

import pytest
from pyspark.sql import functions as F

from chronopath.functions import fields as X

LINE = "array<struct<x: double, y: double>>"


def test_encoded_lines(spark):
    known = [(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)]
    rows = [(1, "_p~iF~ps|U_ulLnnqC_mqNvxq`@", known), (2, "_p~iF", None), (3, "", None), (4, None, None), (5, "_p~iF~ps|U_", None), (6, "??", [(0.0, 0.0)])]
    df = spark.createDataFrame(rows, f"i int, text string, line {LINE}")
    got = {r.i: r.p and [(round(p.x, 5), round(p.y, 5)) for p in r.p] for r in df.select("i", X.decode_line(F.col("text")).alias("p")).collect()}
    assert got == {i: w for i, _, w in rows}
    assert {r.t for r in df.where("i in (1, 6)").select(X.encode_line(F.col("line")).alias("t")).collect()} == {rows[0][1], "??"}


def test_attributes_codes_times_and_points(spark):
    df = spark.createDataFrame([(None, "tf ", "24:10"), (" NaN ", "AGAINST", "7:05:30"), ("main st ", None, "x:1"), ("", "F", "-1:00")], "name string, code string, time string")
    got = df.select(X.known(F.col("name")).alias("n"), X.turn_by_code(F.lit(30.0), F.col("code")).alias("a"), F.date_format(X.schedule_time(F.lit("2026-05-14"), F.col("time")), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()
    assert [tuple(r) for r in got] == [("UNKNOWN", 30.0, "2026-05-15 00:10:00"), ("UNKNOWN", 150.0, "2026-05-14 07:05:30"), ("main st", 30.0, None), ("UNKNOWN", 150.0, None)]
    p = spark.createDataFrame([("40.5,-73.9 40.6,-73.8",), ("1 2 3",), ("1",), (None,)], "text string").select(X.points(F.col("text")).alias("p")).collect()
    assert [r.p and [tuple(x) for x in r.p] for r in p] == [[(40.5, -73.9), (40.6, -73.8)], None, None, None]


def test_stable_order(spark):
    from chronopath.operators.studies import stable_order

    kind = "q int, path array<int>, s double, e double, arrival array<int>, pieces array<int>, pivots array<int>"
    rows = [(0, [1, 2], 0.0, 1.0, [1], [1], [2, 1]), (0, [1, 2], 0.0, 1.0, [1], [1], [1, 3]), (0, [1], 0.0, 9.0, [1], [1], []), (0, [0], 1.0, 2.0, [], [], []), (1, [], 0.0, 0.0, [], [], [])]
    got = [(r.q, r.place, list(r.path), list(r.pivots)) for r in stable_order(spark.createDataFrame(rows, kind).repartition(3), ["q"]).orderBy("q", "place").collect()]
    assert got == [(0, 1, [1], []), (0, 2, [1, 2], [2, 1]), (0, 3, [1, 2], [1, 3]), (0, 4, [0], []), (1, 1, [], [])]


@pytest.mark.parametrize("digits", [5, 6])
def test_lines_come_back(spark, digits):
    df = spark.createDataFrame([([(float(i * 37 % 360 - 180), float(i * 11 % 180 - 90)) for i in range(n)],) for n in (1, 2, 40)], f"line {LINE}")
    r = df.select("line", X.decode_line(X.encode_line(F.col("line"), digits), digits).alias("back")).collect()
    assert all([tuple(p) for p in x.line] == [tuple(p) for p in x.back] for x in r)
