"""Every registered query against its SQL counterpart."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from tests.conftest import SF_DIR

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    return repr(value + 0.0) if isinstance(value, float) else str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    ours = table_of(df.columns, df.collect())
    if name not in ORACLES:
        assert ours[1]
        return
    found = duck.execute(ORACLES[name])
    theirs = table_of([c[0] for c in found.description], found.fetchall())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    rows = contract.entry(spark).collect()
    assert {r["section"] for r in rows} == {"meta", "kpi", "bar", "line", "pie", "top"}
