"""Totals at levels, multiset audit, SQL functions and JSON documents."""

import pytest
from pyspark.sql import functions as F

from panelcast.functions.breakpoints import BREAKPOINTS, sub_index
from panelcast.functions.sql import register
from panelcast.operators.evaluate import regression_metrics
from panelcast.operators.levels import metrics_by_levels, split_audit
from panelcast.sources.documents import document_counts, json_readings


def test_levels_equal_separate_aggregates(spark):
    rows = [(c, y, float(i % 7), float(i % 5)) for i, (c, y) in enumerate([("A", 2000), ("A", 2001), ("B", 2000), (None, 2000), ("B", None)] * 12)]
    df = spark.createDataFrame(rows, "city string, year int, y double, p double")
    levels = [("city", "year"), ("city",), (), ("year",)]
    got = metrics_by_levels(df, levels, "y", "p").collect()
    want = 0
    for i, level in enumerate(levels):
        for r in regression_metrics(df, "y", "p", by=list(level) or None).collect():
            want += 1
            mine = [g for g in got if g["level"] == i and all(g[c] == r[c] for c in level)]
            assert len(mine) == 1 and mine[0]["n"] == r["n"]
            assert all(mine[0][c] == pytest.approx(r[c], nan_ok=True) for c in ("RMSE", "MAE", "MAPE", "R2"))
            assert all(mine[0][c] is None for c in ("city", "year") if c not in level)
    assert len(got) == want
    assert metrics_by_levels(df, [()], "y", "p").first()["n"] == len(rows)


def test_split_audit_counts_multisets(spark):
    schema = "a int, b string, other int"
    train = spark.createDataFrame([(1, "x", 0), (1, "x", 1), (1, None, 2), (2, None, 3)], schema)
    test = spark.createDataFrame([(1, "x", 9), (1, None, 9), (1, None, 8), (3, "z", 9)], schema)
    assert split_audit(train, test, ["a", "b"]).first().asDict() == {"train_rows": 4, "test_rows": 4, "shared": 2, "train_only": 2, "test_only": 2}
    none = train.filter("false")
    assert split_audit(none, none, ["a", "b"]).first().asDict() == dict.fromkeys(("train_rows", "test_rows", "shared", "train_only", "test_only"), 0)


def test_sql_functions_equal_the_columns(spark):
    names = register(spark)
    assert {"aqi", "number_of", "split_label", "breakpoints", "pm10_index"} <= set(names) and register(spark) == names
    edges = [None, -1.0, 0.0, 30.0, 30.5, 31.0, 250.0, 250.5, 430.0, 500.0, 500.1, 9e9, float("nan")]
    df = spark.createDataFrame([(x,) for x in edges], "x double")
    for name in ("pm2_5", "pm10", "so2", "no2"):
        both = df.select(F.expr(f"{name}_index(x)").alias("a"), sub_index("x", BREAKPOINTS[name]).alias("b")).collect()
        assert [r["a"] for r in both] == [r["b"] for r in both]
    row = spark.sql("SELECT number_of(' na ') a, number_of('12.5') b, number_of('junk') c, number_of('inf') d, number_of('NaN') e, aqi(10D, NULL, 75D, NULL) f, "
                    "split_label(2001, 2001) g, split_label(2002, 2001) h, split_label(NULL, 2001) i").first()
    assert list(row)[:5] == [None, 12.5, None, None, None] and row["f"] == compute_max(75.0) and list(row)[6:] == ["train", "test", None]
    assert spark.sql("SELECT count(*) FROM breakpoints('so2')").first()[0] == 6 and spark.sql("SELECT * FROM breakpoints('x')").count() == 0


def compute_max(pm10):
    return 51 + (pm10 - 51) / 49 * 49


def test_json_documents(spark):
    docs = ['{"location": "A", "date": "2020-01-01", "readings": {"so2": "12", "no2": 3.5, "x": "1"}, "more": [1]}', '{"location": "B"}', '{"location": "C", "readings": {"so2"', "", None, "[1]", '"text"',
            '{"readings": {"so2": null}, "date": null}']
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], "k int, document string, so2 string")
    out = json_readings(df, pollutants=["so2", "no2"])
    assert out.columns == ["k", "location", "date", "so2", "no2", "bad"]
    got = {r["k"]: tuple(r)[1:] for r in out.collect()}
    assert got[0] == ("A", "2020-01-01", "12", "3.5", False) and got[1] == ("B", None, None, None, False) and got[7] == (None, None, None, None, False)
    assert all(got[k] == (None, None, None, None, True) for k in (2, 3, 4, 6))
    assert document_counts(out).first()["documents"] == 8 and document_counts(out.filter("false")).first().asDict() == {"documents": 0, "bad": 0}
