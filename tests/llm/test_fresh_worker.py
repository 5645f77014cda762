"""Every query alone in Python workers that have imported nothing else, and those with SQL against it."""

import glob
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from chronopath.llm.queries import QUERIES, SQL

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"
CODE = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.python.worker.reuse", "false").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate())
import __spark_entry__ as e
for name, query in e.queries().items():
    if name.startswith("op") or name == "pipeline":
        print(name, query(spark, sys.argv[2]).count(), flush=True)
"""


def test_each_query_in_a_fresh_worker(tmp_path):
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", CODE, str(tmp_path), SF], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith(("op", "pipeline")))
    assert set(counts) == {*QUERIES, "pipeline"} and all(int(n) > 0 for n in counts.values())


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].astype(str).values.tolist())) == sorted(map(tuple, want[columns].astype(str).values.tolist()))
