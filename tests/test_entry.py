"""Driver contract: every query has a callable, the flagship runs, and the
SQL-expressible queries agree with DuckDB on sf0.001."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as E

from conftest import SF001

TABLES = ["lineitem", "events"]
PARITY = list(E._ORACLE)


def test_contract_keys():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 40


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and rows[0]["n"] > 0 and rows[0]["RMSE"] > 0


def _norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    def n(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 9)
        if isinstance(v, (dt.date, dt.datetime)):
            return v.isoformat()
        return v
    return sorted((tuple(repr(n(r[i])) for i in order) for r in rows))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF001, t + '.parquet')}')")
    return con


@pytest.mark.parametrize("name", PARITY)
def test_oracle_parity_sf0001(spark, duck, name):
    sdf = E.queries()[name](spark, SF001)
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert _norm(sdf.collect(), sdf.columns) == _norm(rel.fetchall(), rel.columns)


def test_fits_read_staged_rows(spark):
    """No fit of a model repeats the windows, and the readings are dealt without a sort."""
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "Window" not in plan(E._month_vectors(spark, SF001))
    assert "spm" not in E._with_index(spark, SF001).columns
    assert "RoundRobin" not in plan(E._readings(spark, SF001))


def test_staged_readings_are_parsed_and_indexed_without_lambdas(spark):
    """What is written before it is filtered needs no binding, and a query that reads the index alone stages that."""
    plan = E._indexed(spark, SF001)._jdf.queryExecution().toString()
    assert "lambda" not in plan
    assert E._with_index(spark, SF001, E.PANEL_COLUMNS).columns == list(E.PANEL_COLUMNS)


def test_unbound_dates_equal_bound_ones(spark):
    from panelcast.functions.dates import parse_date
    texts = ["2020-01-31", "31-01-2020", "01/31/2020", "2020/01/31", " na ", "", None, "2020-13-01", "31/01/2020", "12020-01-31", "x", "2020-1-3"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    out = df.select(parse_date("s").alias("a"), parse_date("s", bind=False).alias("b")).collect()
    assert [r["a"] for r in out] == [r["b"] for r in out] and out[0]["a"] == dt.date(2020, 1, 31)
