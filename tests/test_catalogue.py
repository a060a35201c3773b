"""Each named query against DuckDB on the same tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from quarry import catalogue
from tests.conftest import SMALL

TABLES = (*catalogue.TABLES,)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def value(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(([value(r[k]) for k in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    mine = catalogue.queries()[name](spark, SMALL)
    theirs = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine.columns, mine.collect()) == rows(theirs.columns, theirs.fetchall())


READ = [n for n, q in catalogue.QUERIES.items() if q.collation == catalogue.CASE_SENSITIVE and ";" not in q.sql and not q.sql.startswith("SHOW")]


@pytest.mark.parametrize("name", sorted(READ))
def test_query_under_the_default_collation(spark, duck, name):
    """The tables have no texts that differ by case alone."""
    mine = catalogue.session(spark, SMALL, "utf8mb4_general_ci").sql(catalogue.QUERIES[name].sql)
    theirs = duck.sql(catalogue.oracle_sql()[name])
    assert rows(mine.columns, mine.collect()) == rows(theirs.columns, theirs.fetchall())


def test_pushdown_and_pruning(spark):
    plan = catalogue.session(spark, SMALL).sql("SELECT l_orderkey FROM lineitem WHERE l_quantity > 49")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
