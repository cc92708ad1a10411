"""Every registered query with SQL gives the rows that DuckDB gives for it."""

import datetime

import duckdb
import pytest

from tidewright import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.isoformat(" ")
    if isinstance(v, datetime.date):
        return v.isoformat()
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, con, name):
    df = registry.queries()[name](spark, DIR)
    r = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(tuple(plain(row[columns.index(c)]) for c in sorted(columns)) for row in r.fetchall())
    assert sorted(tuple(plain(row[c]) for c in sorted(columns)) for row in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_gives_rows(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.queries()["bench_filter_limit"](spark, DIR)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(value,90.0)" in plan and "props" not in plan.split("ReadSchema")[1].split("\n")[0]
