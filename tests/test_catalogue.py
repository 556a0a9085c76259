"""Every query of the catalogue against its DuckDB twin, over whole tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from gatehouse import queries, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module", autouse=True)
def ranked_once(spark):
    """Most queries start from the same ranking: it is made once for these tests."""
    made = views.label_ranks(spark, SF).cache()
    own = views.label_ranks
    for module in (views, queries.ranking):
        module.label_ranks = lambda s, d: made
    yield
    for module in (views, queries.ranking):
        module.label_ranks = own
    made.unpersist()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        return v

    return sorted(columns), sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    want = duck.sql(queries.ORACLE_SQL[name])
    assert got == canonical(want.columns, want.fetchall())


#: A ridge classifier solves for matrices, which SQL cannot: test_learning holds the query against numpy.
WITHOUT_SQL = {"probe_linear"}


def test_every_query_has_an_oracle():
    assert sorted(queries.QUERIES) == sorted({*queries.ORACLE_SQL, *WITHOUT_SQL})


def test_entry(spark):
    board = entry_module.entry(spark).collect()
    assert [r.policy for r in board] and len(board) == 6
    assert set(queries.QUERIES) <= set(entry_module.queries())
