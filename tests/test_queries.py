"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    flat = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert flat(got) == flat(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_components_over_all_customers(spark, duck):
    """Every customer and every nation that has one is there, with the least node of its component by brute force."""
    links = [(k, -1 - n) for k, n in duck.sql("SELECT c_custkey, c_nationkey FROM customer").fetchall()]
    component = {x: x for pair in links for x in pair}
    while any(component[a] != component[b] for a, b in links):
        for a, b in links:
            component[a] = component[b] = min(component[a], component[b])
    got = entry.queries()["components_customers"](spark, SF).collect()
    assert len(got) == len(component) and {x.node: x.component for x in got} == component
