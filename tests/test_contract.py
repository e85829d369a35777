"""The driver's contract, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from corpusprov import plans

SF = "/root/testdata/sf0.001"
QUERIES = contract.queries()
ORACLES = contract.oracle_sql()
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


def plain(value):
    return repr(value + 0.0) if isinstance(value, float) else repr(value)


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for f in sorted(Path(SF).glob("*.parquet")):
        out.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return out


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(plans.queries()) == set(plans.oracle_sql())


@needs_data
def test_entry(spark):
    assert contract.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(tuple(map(plain, r)) for r in cursor.fetchall())
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == want
