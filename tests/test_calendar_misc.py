"""Calendar mode, per-entity split, observed profile, comparison table, folds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcast.operators.calendar import add_range_columns, calendar_features, calendar_target, daily_panel
from panelcast.operators.evaluate import comparison_table
from panelcast.operators.split import entity_date_split
from panelcast.sources.readings import observe_profile

D = dt.date


def test_calendar_target_checks_gap(spark):
    rows = [("A", D(2020, 1, 1), 1.0), ("A", D(2020, 1, 1), 3.0), ("A", D(2020, 1, 2), 5.0),
            ("A", D(2020, 1, 4), 7.0), ("B", D(2020, 1, 1), 10.0), ("B", D(2020, 1, 2), 20.0)]
    df = spark.createDataFrame(rows, "city string, date_parsed date, AQI double")
    daily = daily_panel(df, "city", "date_parsed", ["AQI"])
    got = {(r["city"], r["date_parsed"]): (r["AQI"], r["readings"], r["AQI_target_1d"])
           for r in calendar_target(daily, "city", "date_parsed", "AQI", 1, drop_null=False).collect()}
    assert got[("A", D(2020, 1, 1))] == (2.0, 2, 5.0)
    assert got[("A", D(2020, 1, 2))][2] is None  # next row is two days later
    assert got[("B", D(2020, 1, 1))][2] == 20.0
    two = {(r["city"], r["date_parsed"]): r["AQI_target_2d"]
           for r in calendar_target(daily, "city", "date_parsed", "AQI", 2).collect()}
    assert two == {("A", D(2020, 1, 2)): 7.0}


@pytest.mark.parametrize("strategy", ["plain", "chunked"])
def test_calendar_target_strategies_agree(spark, strategy):
    rows = [("A", D(2020, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(20) if i % 5 != 3]
    daily = daily_panel(spark.createDataFrame(rows, "city string, date_parsed date, AQI double"),
                        "city", "date_parsed", ["AQI"])
    out = calendar_target(daily, "city", "date_parsed", "AQI", 1, strategy=strategy, chunk_rows=4)
    assert sorted(r["AQI"] for r in out.collect()) == [float(i) for i in range(19) if i % 5 not in (2, 3)]


def test_entity_date_split(spark):
    rows = [("A", D(2020, 1, d)) for d in range(1, 11)] + [("B", D(2020, 2, d)) for d in range(1, 6)] + [(None, D(2020, 1, 1))]
    out = entity_date_split(spark.createDataFrame(rows, "city string, date_parsed date"), "city", 0.8)
    counts = {(r["city"], r["split"]): r["count"] for r in out.groupBy("city", "split").count().collect()}
    assert counts[("A", "train")] == 8 and counts[("A", "test")] == 2
    assert counts[("B", "train")] == 4 and counts[("B", "test")] == 1
    assert counts[(None, None)] == 1


def test_observe_profile_no_extra_pass(spark):
    df, obs = observe_profile(spark.range(17))
    df.write.format("noop").mode("overwrite").save()
    assert obs.get["rows"] == 17


def test_comparison_table(spark):
    m = spark.createDataFrame([("b", 2.123456, 1.0, 10.555, 0.5, 1.234), ("a", 1.0, 1.0, 1.0, 0.9, 1.0)],
                              "model string, RMSE double, MAE double, MAPE double, R2 double, training_time_sec double")
    rows = comparison_table(m).collect()
    assert [r["model"] for r in rows] == ["a", "b"] and rows[1]["RMSE"] == 2.1235


def test_cross_entity_threads(spark):
    from pyspark.ml.feature import VectorAssembler
    from panelcast.plans.crossval import cross_entity_validation
    rows = [(c, float(i), float(2 * i + (1 if c == "A" else 0))) for c in "ABCD" for i in range(30)]
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.createDataFrame(rows, "city string, x double, AQI_target double"))
    res = cross_entity_validation(df, "city", 2, "LinearRegression", max_workers=2).collect()
    assert sorted(r["city"] for r in res) == ["A", "B"] and all(r["n"] == 30 for r in res)


@pytest.mark.parametrize("block", [1, 5, 1024])
def test_calendar_frames_by_hand(spark, block):
    rows = [(None, D(2020, 1, 1), 4.0, 0), ("A", D(2019, 12, 30), 1.0, 1), ("A", D(2020, 1, 1), 3.0, 2), ("A", D(2020, 1, 1), 5.0, 3), ("A", D(2020, 1, 2), None, 4),
            ("A", D(2020, 1, 3), float("nan"), 5), ("A", D(2020, 1, 4), 8.0, 6), ("A", None, 9.0, 7), ("A", D(1969, 12, 31), 2.0, 8), ("A", D(1970, 1, 1), 6.0, 9)]
    df = spark.createDataFrame(rows, "city string, day date, v double, k int").withColumn("v_lag1d", F.lit("clash"))
    out = calendar_features(df, "city", "day", "v", (1, 2), (3,), block_days=block)
    got = {r["k"]: (r["v_lag1d"], r["v_lag2d"], r["v_rolling_3d"]) for r in out.collect()}
    assert got == {0: (None, None, 4.0), 1: (None, None, 1.0), 2: (None, 1.0, 3.0), 3: (None, 1.0, 3.0), 4: (4.0, None, 4.0),
                   5: (None, 4.0, 4.0), 6: (None, None, 8.0), 7: (None, None, None), 8: (None, None, 2.0), 9: (2.0, None, 4.0)}
    assert calendar_features(df.filter("false"), "city", "day", "v").collect() == []


def test_frames_ahead_cross_blocks(spark):
    df = spark.range(30).select(F.lit("A").alias("e"), F.expr("date_add(date'2020-01-01', cast(id as int))").alias("d"), F.col("id").alias("x"))
    cols = {"s": lambda w: F.sum("x").over(w.rangeBetween(-2, 3))}
    got = {r["x"]: r["s"] for r in add_range_columns(df, "e", "d", cols, 2, 3, block_days=4).collect()}
    assert got == {x: sum(range(max(0, x - 2), min(30, x + 4))) for x in range(30)}
    with pytest.raises(ValueError):
        add_range_columns(df, "e", "d", cols, 2, 3, block_days=0)
