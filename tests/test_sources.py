"""Graph folders and text formats."""

import gzip
import json

import pytest

from chronopath.operators import envelopes as E
from chronopath.operators import paths as P
from chronopath.sources import graph_files as G


def folder(tmp, **change):
    arcs = [(0, 1, 2, 100, 10.0), (1, 2, 3, 100, 12.0), (2, 1, 3, 100, 30.0), (3, 1, 2, 100, 9.0)]
    files = {
        "nodes.csv.gz": "node_id,x,y\n1,0,0\n2,5,5\n3,9,9\n",
        "edges_static.csv.gz": "arc_id,u,v,distance,base_travel_time\n" + "".join(f"{a},{u},{v},{d},{w}\n" for a, u, v, d, w in arcs),
        "travel_time_functions.jsonl.gz": "".join(json.dumps({"arc_id": a, "u": u, "v": v, "distance": d, "base_travel_time": w, "travel_time_breakpoints": [[0, w], [720, w + 3], [1440, w]]}) + "\n" for a, u, v, d, w in arcs),
        "score_functions.jsonl.gz": json.dumps({"arc_id": 0, "u": 1, "v": 2, "selected_for_score": True, "score_intervals": [[0, 420, 0], [420, 600, 9], [600, 1440, 0]]}) + "\n",
        **change,
    }
    for name, text in files.items():
        with gzip.open(tmp / name, "wt") as f:
            f.write(text)
    (tmp / "manifest.json").write_text(json.dumps({"num_nodes": 3, "num_arcs": 4, "seed": 1, "unlisted_edges_have_score_zero": True}))
    return str(tmp)


def test_load_query_and_round_trip(spark, tmp_path):
    f = G.load_graph(spark, folder(tmp_path), verified=True)
    q = spark.createDataFrame([(0, 1, 3, 430, 440, 40)], "query_id int, src int, dst int, ts int, te int, b int")
    seg = E.envelope(P.profiles(f.graph.edges, q), q).collect()
    assert [(r.s, r.e, r.path) for r in seg] == [(430.0, 440.0, [0, 1])]
    assert G.smoke(f.graph, f.nodes).first().asDict() == {"nodes": 3, "arcs": 4, "scored": 1, "not_fifo": 0}
    out = tmp_path / "copy"
    G.write_graph(f, str(out))
    (out / "manifest.json").write_text((tmp_path / "manifest.json").read_text())
    again = G.load_graph(spark, str(out))
    columns = ["arc_id", "u", "v", "knots", "pieces"]
    assert G.checksum(f.graph.edges, columns) == G.checksum(again.graph.edges.repartition(3), columns)


@pytest.mark.parametrize(
    ("name", "text"),
    [
        ("nodes.csv.gz", "node_id,x,y\n1,0,0\n1,5,5\n3,9,9\n"),
        ("edges_static.csv.gz", "arc_id,u,v,distance,base_travel_time\n0,1,2,100,10.0\n2,2,3,100,12.0\n"),
        ("score_functions.jsonl.gz", json.dumps({"arc_id": 0, "u": 1, "v": 2, "selected_for_score": True, "score_intervals": [[0, 1440, 1.5]]})),
        ("travel_time_functions.jsonl.gz", json.dumps({"arc_id": 0, "u": 1, "v": 2, "distance": 1, "base_travel_time": 10.0, "travel_time_breakpoints": [[0, 10], [0, 11]]})),
    ],
)
def test_broken_folders_are_rejected(spark, tmp_path, name, text):
    with pytest.raises(G.InvalidData):
        G.load_graph(spark, folder(tmp_path, **{name: text}))


def test_queries_dimacs_and_pending(spark, tmp_path):
    rows = [{"schema_version": 1, "query_id": f"q{i}", "source": 1, "destination": 4, "interval_start": 420, "interval_end": 430, "budget": 60.0, "budget_policy": "main", "metadata": {"k": "v"}} for i in (2, 1)]
    (tmp_path / "q.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    q = G.read_queries(spark, str(tmp_path / "q.jsonl"))
    G.write_queries(q, str(tmp_path / "out"))
    assert [r.query_id for r in G.read_queries(spark, str(tmp_path / "out")).collect()] == ["q1", "q2"]
    (tmp_path / "d.gr").write_text("c x\np sp 3 2\na 1 2 50\na 2 3 70\n")
    (tmp_path / "t.gr").write_text("p sp 3 2\na 1 2 600\na 2 3 1200\n")
    (tmp_path / "d.co").write_text("p aux sp co 1\nv 1 -7 4\n")
    d, n = G.read_dimacs(spark, str(tmp_path / "d.gr"), str(tmp_path / "d.co"))
    t, _ = G.read_dimacs(spark, str(tmp_path / "t.gr"))
    assert sorted(map(tuple, G.join_dimacs(d, t).collect())) == [(1, 2, 50, 1.0), (2, 3, 70, 2.0)] and n.first().x == -7
    # Of two parallel arcs the longer is the faster: place in the file decides, not cost.
    (tmp_path / "d2.gr").write_text("p sp 2 2\na 1 2 90\na 1 2 50\n")
    (tmp_path / "t2.gr").write_text("p sp 2 2\na 1 2 600\na 1 2 1200\n")
    two = G.join_dimacs(*(G.read_dimacs(spark, str(tmp_path / f))[0] for f in ("d2.gr", "t2.gr")))
    assert sorted(map(tuple, two.collect())) == [(1, 2, 50, 2.0), (1, 2, 90, 1.0)]
    G.write_metrics(spark.createDataFrame([("q2", 1.5), ("q1", 2.0)], "query_id string, travel double"), str(tmp_path / "m"))
    assert [tuple(r) for r in G.read_schedule(spark, str(tmp_path / "m")).collect()] == [("q1", "2.0"), ("q2", "1.5")]
    assert json.loads(G.debug_json(spark.createDataFrame([(1, None)], "a int, b string")).first().json) == {"a": 1, "b": None}
    plan = spark.createDataFrame([("a",), ("b",)], "run_id string")
    G.append_records(plan.where("run_id = 'a'"), str(tmp_path / "rec"))
    assert [r.run_id for r in G.pending(plan, spark.read.json(str(tmp_path / "rec"))).collect()] == ["b"]
    (tmp_path / "g.json").write_text(json.dumps({"features": [{"properties": {"id": "1"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    assert G.read_geojson(spark, str(tmp_path / "g.json")).first().properties == {"id": "1"}
