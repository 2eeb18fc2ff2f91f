"""Every registered query with SQL against DuckDB on the smallest tables; the others give rows."""

import math
import os

import duckdb
import pytest

from telemark.plans import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return con


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}") + 0.0
    return value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(plain(r[i])) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    relation = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(relation.columns)
    got, want = rows(df.columns, df.collect()), rows(relation.columns, relation.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b or all(x == y or math.isclose(float(x), float(y), rel_tol=1e-9) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_gives_rows(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(registry.queries())
