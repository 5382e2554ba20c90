import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as e

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def test_entry(spark):
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(e.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    got, want = e.queries()[name](spark, DATA).toPandas(), con.execute(e.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(e.queries()) - set(e.oracle_sql())))
def test_query_runs(spark, name):
    e.queries()[name](spark, DATA).count()


def test_core_queries_stand_without_the_subpackages_needs():
    """Where what the subpackage needs cannot be imported, the core queries are still there."""
    import subprocess
    import sys

    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) >= 44 and 'p1_found' not in q and 'bucket_counts' in q and set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(e.__file__))
