"""Every query that has SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from chronopath import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df, columns):
    def cell(x):
        if x is None or x != x:
            return "null"
        return repr(round(float(x), 5) + 0.0) if isinstance(x, (int, float)) or hasattr(x, "dtype") or type(x).__name__ == "Decimal" else str(x)

    return sorted(tuple(cell(x) for x in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = con.execute(catalog.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).collect() is not None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_needs_no_session():
    """The entry module is read before any session is there."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True)
