"""Streams over landed files."""

import datetime as dt

from chronopath.streaming import ingest

SCHEMA = "link string, ts timestamp, value string"


def rows(n, minute=0):
    t = dt.datetime(2024, 1, 1)
    return [(f"l{i % 3}", t + dt.timedelta(minutes=minute + i), "x" if i % 7 == 0 else str(i)) for i in range(n)]


def test_collect_bins_best_and_frontier(spark, tmp_path):
    land = str(tmp_path / "land")
    spark.createDataFrame(rows(40), SCHEMA).write.mode("append").parquet(land)
    spark.createDataFrame(rows(40), SCHEMA).write.mode("append").parquet(land)
    stream = lambda: ingest.observations(spark, land, SCHEMA)
    ingest.collect_once(stream(), ["link", "ts"], "ts", "1 hour", str(tmp_path / "kept"), str(tmp_path / "c1")).awaitTermination(90)
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 40
    bins = ingest.tumbling(stream(), ["link"], "ts", "value", "15 minutes", "0 minutes")
    ingest.write_bins(bins, str(tmp_path / "bins"), str(tmp_path / "c2")).awaitTermination(90)
    got = spark.read.parquet(str(tmp_path / "bins")).collect()
    assert got and all(r.n >= r.n_valid for r in got)
    scored = stream().selectExpr("link", "try_cast(value as double) as score", "ts").where("score is not null")
    ingest.best_so_far(scored, ["link"], "score", ["ts"], str(tmp_path / "best"), str(tmp_path / "c3")).awaitTermination(90)
    best = {r.link: r.score for r in spark.read.parquet(str(tmp_path / "best" / "v=0")).collect()}
    want: dict = {}
    for link, _, v in rows(40):
        if v != "x":
            want[link] = max(want.get(link, 0.0), float(v))
    assert best == want
    pairs = stream().selectExpr("link", "try_cast(value as double) as v", "cast(minute(ts) as double) as c").where("v is not null")
    ingest.running_frontier(pairs, "link", "v", "c", 5, str(tmp_path / "front"), str(tmp_path / "c4")).awaitTermination(90)
    assert spark.read.parquet(str(tmp_path / "front")).count() > 0
