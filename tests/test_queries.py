"""Every query with SQL gives the rows of that SQL in DuckDB; every other query runs and has a stable schema."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()]
    found = duck.sql(ORACLES[name])
    order = sorted(range(len(found.columns)), key=lambda k: found.columns[k])
    want = [tuple(plain(r[k]) for k in order) for r in found.fetchall()]
    assert sorted(df.columns) == sorted(found.columns)
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scalar_functions_of_odd_values(spark, tmp_path):
    """Logarithms of zero and of less than zero are those of the SQL."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i AS event_id, v AS value, 'click' AS event_type FROM (VALUES (1, 0.0::DOUBLE), (2, -0.0), (3, -2.5), (4, NULL), (5, 8.0)) t(i, v)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    df = entry.queries()["scalar_functions"](spark, str(tmp_path))
    names = ["event_id", "ln_", "log2_", "root", "power_", "e", "lo", "hi", "byte", "missing"]
    got = sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
    want = sorted(tuple(map(plain, r)) for r in con.sql(f"SELECT {', '.join(names)} FROM ({ORACLES['scalar_functions']})").fetchall())
    assert got == want
    assert [r[1:3] for r in got] == [(-math.inf, -math.inf), (-math.inf, -math.inf), ("nan", "nan"), (None, None), (2.079442, 3.0)]
