"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from tests.conftest import SMALL

QUERIES, SQL = contract.queries(), contract.oracle_sql()
VIEWS = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
         "conversations").split()
DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
# an inequality join with a dimension table is the feature itself
INEQUALITY = {"join_theta_budget"}


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in VIEWS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def normal(row, order):
    return tuple(repr(row[c]) if isinstance(row[c], float) else str(row[c]) for c in order)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan or name in INEQUALITY
    rows = [r.asDict() for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(names) == sorted(df.columns)
    assert {c: DUCK_TYPES[t] for c, t in df.dtypes} == types
    order = sorted(names)
    expected = [dict(zip(names, r)) for r in cursor.fetchall()]
    assert sorted(normal(r, order) for r in rows) == sorted(normal(r, order) for r in expected)


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 12 and df.columns[0] == "scope"
