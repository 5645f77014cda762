"""Graph folders, manifests and related text formats as DataFrames. gzip files are read as they are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronopath.functions import temporal as T
from chronopath.plans.temporal_graph import Graph

NODES = "node_id INT, x BIGINT, y BIGINT"
ARCS = "arc_id INT, u INT, v INT, distance BIGINT, base_travel_time DOUBLE"
TRAVEL = f"{ARCS}, travel_time_breakpoints ARRAY<ARRAY<DOUBLE>>"
SCORES = "arc_id INT, u INT, v INT, selected_for_score BOOLEAN, score_intervals ARRAY<ARRAY<DOUBLE>>"
MANIFEST = "num_nodes INT, num_arcs INT, seed BIGINT, selected_score_edge_count INT, unlisted_edges_have_score_zero BOOLEAN, rush_windows MAP<STRING, ARRAY<DOUBLE>>, schema_version INT, temporal_support ARRAY<DOUBLE>, dataset_checksum STRING"
QUERY = "schema_version INT, query_id STRING, dataset_id STRING, source INT, destination INT, interval_start INT, interval_end INT, window_length INT, budget DOUBLE, budget_slack DOUBLE, budget_policy STRING, distance_bin INT, lower_bound_distance DOUBLE, query_seed BIGINT, metadata MAP<STRING, STRING>"


class InvalidData(ValueError):
    """Input that breaks its format's contract; the message says how and how often."""


def _none(df: DataFrame, what: str) -> None:
    n = df.count()
    if n:
        raise InvalidData(f"{what}: {n} rows")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """CSV with the exact header node_id,x,y; ids must be positive and unique."""
    df = spark.read.csv(path, header=True, schema=NODES, enforceSchema=False, mode="FAILFAST")
    _none(df.where("node_id is null or node_id <= 0 or x is null or y is null"), "invalid nodes")
    _none(df.groupBy("node_id").count().where("count > 1"), "node ids that repeat")
    return df


def read_arcs(spark: SparkSession, path: str) -> DataFrame:
    """CSV with the exact header; arc ids must be 0, 1, 2, … without gaps."""
    df = spark.read.csv(path, header=True, schema=ARCS, enforceSchema=False, mode="FAILFAST")
    r = df.agg(F.count("*").alias("n"), F.min("arc_id").alias("lo"), F.max("arc_id").alias("hi"), F.count_distinct("arc_id").alias("d")).first()
    if r.n and (r.lo, r.hi, r.d) != (0, r.n - 1, r.n):
        raise InvalidData(f"arc ids are not consecutive: {r.n} rows from {r.lo} to {r.hi}")
    return df


def read_travel(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines: ``(arc_id, u, v, distance, base_travel_time, knots)``, one row an arc, knots in order."""
    raw = spark.read.json(path, schema=TRAVEL, mode="FAILFAST")
    df = raw.select("arc_id", "u", "v", "distance", "base_travel_time", F.transform("travel_time_breakpoints", lambda k: F.struct(F.get(k, F.lit(0)).alias("t"), F.get(k, F.lit(1)).alias("v"))).alias("knots"))
    _none(df.groupBy("arc_id").count().where("count > 1"), "arcs with two travel functions")
    _none(df.where(F.exists(T.segments(F.col("knots")), lambda s: s["t1"] <= s["t0"]) | (F.size("knots") < 1) | F.exists("knots", lambda k: k["v"].isNull() | (k["v"] < 0))), "invalid travel functions")
    return df


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines: ``(arc_id, pieces)``; scores must be whole and not negative, pieces in order without gaps."""
    raw = spark.read.json(path, schema=SCORES, mode="FAILFAST")
    bad = F.exists("score_intervals", lambda p: (F.size(p) != 3) | (F.get(p, F.lit(2)) != F.floor(F.get(p, F.lit(2)))) | (F.get(p, F.lit(2)) < 0))
    _none(raw.where(bad), "scores that are not whole")
    df = raw.select("arc_id", "u", "v", F.transform("score_intervals", lambda p: F.struct(F.get(p, F.lit(0)).alias("t0"), F.get(p, F.lit(1)).alias("t1"), F.get(p, F.lit(2)).cast("long").alias("score"))).alias("pieces"))
    _none(df.groupBy("arc_id").count().where("count > 1"), "arcs with two score functions")
    return df


def read_manifest(spark: SparkSession, path: str):
    """The manifest's row, or None where there is no such file."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.json(path, schema=MANIFEST, multiLine=True).first()
    except AnalysisException:
        return None


@dataclass(frozen=True)
class Folder:
    nodes: DataFrame
    graph: Graph
    manifest: object


def load_graph(spark: SparkSession, folder: str, verified: bool = False, suffix: str = ".gz") -> Folder:
    """A folder with nodes.csv, edges_static.csv, travel_time_functions.jsonl, score_functions.jsonl and manifest.json.

    Counts must agree with the manifest, every arc needs a travel function with its own ends and base time, and arcs
    without a score function have score 0 over their travel time's support where the manifest says so. ``verified``
    also asks for FIFO functions and a positive lower bound.
    """
    nodes = read_nodes(spark, f"{folder}/nodes.csv{suffix}")
    arcs = read_arcs(spark, f"{folder}/edges_static.csv{suffix}")
    travel = read_travel(spark, f"{folder}/travel_time_functions.jsonl{suffix}")
    scores = read_scores(spark, f"{folder}/score_functions.jsonl{suffix}")
    m = read_manifest(spark, f"{folder}/manifest.json")
    if m and ((m.num_nodes is not None and m.num_nodes != nodes.count()) or (m.num_arcs is not None and m.num_arcs != arcs.count())):
        raise InvalidData("counts differ from the manifest's")
    t = travel.select("arc_id", F.col("u").alias("_u"), F.col("v").alias("_v"), F.col("base_travel_time").alias("_w"), "knots")
    j = arcs.join(t, "arc_id", "left")
    _none(j.where("knots is null or u <> _u or v <> _v or base_travel_time <> _w"), "arcs whose travel function is missing or differs")
    ends = arcs.select(F.explode(F.array("u", "v")).alias("node_id")).distinct().join(nodes, "node_id", "left_anti")
    _none(ends, "arc ends that are no nodes")
    zero = F.array(F.struct(F.get("knots", F.lit(0))["t"].alias("t0"), F.element_at("knots", -1)["t"].alias("t1"), F.lit(0).cast("long").alias("score")))
    edges = j.join(scores.select("arc_id", "pieces"), "arc_id", "left")
    if not (m and m.unlisted_edges_have_score_zero):
        _none(edges.where("pieces is null"), "arcs without a score function")
    edges = edges.select("arc_id", "u", "v", F.col("base_travel_time").alias("w"), T.min_value(F.col("knots")).alias("lb"), "knots", F.coalesce("pieces", zero).alias("pieces"))
    if verified:
        _none(edges.where(~T.is_fifo(F.col("knots"))), "arcs that are not FIFO")
        _none(edges.where("lb <= 0"), "arcs without a positive lower bound")
    knots = edges.select("arc_id", F.posexplode("knots").alias("k", "x")).select("arc_id", "k", "x.t", F.col("x.v").alias("tau"))
    pieces = edges.select("arc_id", F.posexplode("pieces").alias("k", "x")).select("arc_id", "k", "x.t0", "x.t1", "x.score")
    none = spark.createDataFrame([], "query_id int, src int, dst int, ts int, te int, b int")
    return Folder(nodes, Graph(edges, knots, pieces, none), m)


def write_graph(folder: Folder, path: str) -> None:
    """The same folder layout, each file a Spark folder of parts (gzip)."""
    e = folder.graph.edges
    folder.nodes.write.csv(f"{path}/nodes.csv.gz", header=True, compression="gzip", mode="overwrite")
    e.select("arc_id", "u", "v", F.lit(0).cast("long").alias("distance"), F.col("w").alias("base_travel_time")).write.csv(f"{path}/edges_static.csv.gz", header=True, compression="gzip", mode="overwrite")
    e.select("arc_id", "u", "v", F.lit(0).cast("long").alias("distance"), F.col("w").alias("base_travel_time"), F.transform("knots", lambda k: F.array(k["t"], k["v"])).alias("travel_time_breakpoints")).write.json(f"{path}/travel_time_functions.jsonl.gz", compression="gzip", mode="overwrite")
    e.select("arc_id", "u", "v", F.lit(True).alias("selected_for_score"), F.transform("pieces", lambda p: F.array(p["t0"], p["t1"], p["score"].cast("double"))).alias("score_intervals")).write.json(f"{path}/score_functions.jsonl.gz", compression="gzip", mode="overwrite")


def smoke(graph: Graph, nodes: DataFrame) -> DataFrame:
    """One row: nodes, arcs, arcs with a positive score, arcs that are not FIFO."""
    x = graph.edges.agg(F.count("*").alias("arcs"), F.sum((T.score_max(F.col("pieces")) > 0).cast("long")).alias("scored"), F.sum((~T.is_fifo(F.col("knots"))).cast("long")).alias("not_fifo"))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(x)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Query manifest, JSON lines; ids must be unique."""
    df = spark.read.json(path, schema=QUERY, mode="FAILFAST")
    _none(df.where("query_id is null or source is null or destination is null or interval_start > interval_end or budget < 0"), "invalid queries")
    _none(df.groupBy("query_id").count().where("count > 1"), "query ids that repeat")
    return df


def write_queries(df: DataFrame, path: str) -> None:
    """One canonical JSON-lines part in query order."""
    df.orderBy("query_id").coalesce(1).write.json(path, mode="overwrite")


def write_metrics(df: DataFrame, path: str) -> None:
    """Point metrics as CSV with a header, one part in query order."""
    df.orderBy("query_id").coalesce(1).write.csv(path, header=True, mode="overwrite")


def debug_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON document, nulls written out."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def read_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """CSV pages of a folder, every column as text."""
    return spark.read.csv(folder, header=True, inferSchema=False)


def append_records(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("append").format(fmt).option("header", True).save(path)


def pending(plan: DataFrame, done: DataFrame, key: str = "run_id") -> DataFrame:
    """Rows of a plan without a record yet: how an interrupted run goes on."""
    return plan.join(done.select(key).distinct(), key, "left_anti")


def read_dimacs(spark: SparkSession, graph: str, coordinates: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """DIMACS text: arcs ``(at, u, v, cost)`` of a .gr file, ``at`` their place in it, and nodes ``(node_id, x, y)`` of a .co file."""
    def parts(path: str, kind: str) -> DataFrame:
        lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"))
        return lines.where(F.col("value").startswith(f"{kind} ")).select("at", F.split("value", r"\s+").alias("p"))

    arcs = parts(graph, "a").select("at", F.col("p")[1].cast("int").alias("u"), F.col("p")[2].cast("int").alias("v"), F.col("p")[3].cast("long").alias("cost"))
    nodes = parts(coordinates, "v").select(F.col("p")[1].cast("int").alias("node_id"), F.col("p")[2].cast("long").alias("x"), F.col("p")[3].cast("long").alias("y")) if coordinates else None
    return arcs, nodes


def join_dimacs(distance: DataFrame, travel: DataFrame, unit: int = 10) -> DataFrame:
    """Arcs of a distance and a travel-time file: the k-th arc of an (u, v) pair in one file is the k-th in the other."""
    w = Window.partitionBy("u", "v").orderBy("at")  # parallel arcs of one pair only
    d = distance.withColumn("k", F.row_number().over(w)).select("u", "v", "k", F.col("cost").alias("distance"))
    t = travel.withColumn("k", F.row_number().over(w)).select("u", "v", "k", F.col("cost").alias("ticks"))
    j = d.join(t, ["u", "v", "k"], "full")
    _none(j.where("distance is null or ticks is null"), "arcs in one file only")
    return j.select("u", "v", "distance", (F.col("ticks") / unit / 60).alias("base_travel_time"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON pages: ``(properties map, geometry_type, coordinates json)``."""
    schema = "features ARRAY<STRUCT<properties: MAP<STRING, STRING>, geometry: STRUCT<type: STRING, coordinates: STRING>>>"
    return spark.read.json(path, schema=schema, multiLine=True).select(F.explode("features").alias("f")).select("f.properties", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def checksum(df: DataFrame, columns: list[str]) -> str:
    """SHA-256 over the rows' own digests in order of those: the same for any partitioning or row order.

    Rows are first summed per leading byte of their digest, so what is put together last has 256 entries at most.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(c).alias(c) for c in columns]), {"ignoreNullFields": "false"}), 256)
    part = df.select(row.alias("d")).groupBy(F.substring("d", 1, 2).alias("p")).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("d", 3, 14), 16, 10).cast("decimal(38,0)")).alias("s"), F.bit_xor(F.conv(F.substring("d", 20, 15), 16, 10).cast("long")).alias("x"))
    return part.agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(F.concat_ws(":", "p", "n", "s", "x")))), 256).alias("c")).first().c
