"""Split contract (§2.9), medians, IQR, metrics, audit, entity folds."""

import datetime as dt
import math

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from panelcast.operators.audit import row_drop_audit
from panelcast.operators.entities import fold_sizes, leave_one_out, top_entities
from panelcast.operators.evaluate import label_stats, regression_metrics
from panelcast.operators.impute import fill_values, fit_medians, impute_median
from panelcast.operators.outliers import IQRBounds, filter_iqr, fit_iqr_bounds, flag_outliers, iqr_bounds_frame
from panelcast.operators.split import chronological_split, cumulative_share, fit_split, split_summary, assign_split


def _years(spark, counts):
    rows = []
    for y, n in counts.items():
        rows += [(y, dt.date(y, 1 + i % 12, 1)) for i in range(n)]
    return spark.createDataFrame(rows, "year int, date_parsed date")


def test_years_2_min_test_2_raises(spark):
    with pytest.raises(ValueError, match="test years"):
        fit_split(_years(spark, {2000: 5, 2001: 5}), 0.8, 2)


def test_years_skew_clamp_picks_27th_year(spark):
    counts = {1987 + i: 10 for i in range(27)}
    counts[2014] = 38
    counts[2015] = 38  # last two years hold ~22% of rows
    b = fit_split(_years(spark, counts), 0.8, 2)
    assert b.kind == "year" and b.last_train_year == 1987 + 26


def test_ratio_reached_early_then_clamped(spark):
    b = fit_split(_years(spark, {2000: 90, 2001: 5, 2002: 5}), 0.8, 1)
    assert b.last_train_year == 2000


def test_one_year_date_threshold(spark):
    rows = [(2024, dt.date(2024, 1, d)) for d in range(1, 11)]
    df = spark.createDataFrame(rows, "year int, date_parsed date")
    b = fit_split(df, 0.8, 2)
    assert b.kind == "date" and b.split_date == dt.date(2024, 1, 8)
    train, test = chronological_split(df, 0.8, 2)
    assert train.count() == 8 and test.count() == 2
    assert train.agg(F.max("date_parsed")).first()[0] <= b.split_date < test.agg(F.min("date_parsed")).first()[0]


def test_empty_split_raises(spark):
    with pytest.raises(ValueError):
        fit_split(spark.createDataFrame([], "year int, date_parsed date"))


def test_split_halves_partition_non_null_rows(spark):
    df = _years(spark, {2000: 4, 2001: 3, 2002: 3, 2003: 2}).union(
        spark.createDataFrame([(None, None)], "year int, date_parsed date"))
    train, test = chronological_split(df, 0.5, 1)
    assert train.count() + test.count() == 12
    assert train.agg(F.max("year")).first()[0] < test.agg(F.min("year")).first()[0]
    s = {r["split"]: r["rows"] for r in split_summary(assign_split(df, fit_split(df, 0.5, 1))).collect()}
    assert s == {"train": train.count(), "test": test.count()}


def test_cumulative_share(spark):
    rows = cumulative_share(_years(spark, {2000: 1, 2001: 3})).orderBy("year").collect()
    assert [r["cum_share"] for r in rows] == [0.25, 1.0]


def test_medians_and_fill(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (None, float("nan")), (10.0, 7.0)], "so2 double, no2 double")
    m = fit_medians(df, ["so2", "no2", "missing"])
    assert m["so2"] == 2.0 and "missing" not in m
    filled = impute_median(df, ["so2"]).collect()
    assert [r["so2"] for r in filled] == [1.0, 2.0, 2.0, 10.0]
    assert fill_values(df, {"no2": 0.0}).filter("no2 = 0.0").count() == 2  # null and NaN


def test_empty_iqr_and_median(spark):
    empty = spark.createDataFrame([], "AQI double, so2 double")
    assert fit_iqr_bounds(empty) is None
    assert filter_iqr(empty, None).count() == 0
    assert fit_medians(empty, ["so2"]) == {}


def test_iqr_bounds_inclusive(spark):
    vals = [1, 2, 3, 4, 5, 6, 7, 8, 100, None]
    df = spark.createDataFrame([(None if x is None else float(x),) for x in vals], "AQI double")
    b = fit_iqr_bounds(df)  # exact lower quantiles, as DuckDB quantile_disc: 3 and 7 of 9 values
    assert (b.q1, b.q3) == (3.0, 7.0) and (b.lower, b.upper) == (-3.0, 13.0)
    assert filter_iqr(df, b).count() == 8
    flags = [r["is_outlier"] for r in flag_outliers(df, b).collect()]
    assert flags.count(True) == 2  # 100 and the null value
    assert filter_iqr(df, IQRBounds(2.0, 6.0, 0.0)).count() == 5
    per = iqr_bounds_frame(df.withColumn("g", F.lit("a")), by="g").first()
    assert per["lower"] == -3.0


def test_metrics_formulas_and_evaluator(spark):
    rows = [(float(y), float(y) + (0.5 if y % 2 else -1.0)) for y in range(1, 50)]
    df = spark.createDataFrame(rows, "y double, p double")
    m = regression_metrics(df, "y", "p").first()
    for name, metric in (("RMSE", "rmse"), ("MAE", "mae"), ("R2", "r2")):
        ref = RegressionEvaluator(labelCol="y", predictionCol="p", metricName=metric).evaluate(df)
        assert m[name] == pytest.approx(ref, rel=1e-12)
    ape = [abs(y - p) / abs(y) for y, p in rows]
    assert m["MAPE"] == pytest.approx(100 * sum(ape) / len(ape))


def test_mape_skips_zero_labels_and_all_zero_is_nan(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "y double, p double")
    assert regression_metrics(df, "y", "p").first()["MAPE"] == pytest.approx(50.0)
    zero = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "y double, p double")
    assert math.isnan(regression_metrics(zero, "y", "p").first()["MAPE"])


def test_constant_label_r2_is_zero(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0)], "y double, p double")
    assert regression_metrics(df, "y", "p").first()["R2"] == 0.0


def test_label_stats(spark):
    r = label_stats(spark.createDataFrame([(1.0,), (3.0,)], "AQI_target double")).first()
    assert (r["mean"], r["min"], r["max"]) == (2.0, 1.0, 3.0) and r["std"] == pytest.approx(math.sqrt(2))


def test_row_drop_audit(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (None, 6), (4, 7)], "a int, b int")
    rows = row_drop_audit(df, [("a", F.col("a").isNotNull()), ("b", F.col("b") > 5)]).orderBy("step_no").collect()
    assert [(r["rows_before"], r["rows_after"], r["dropped"]) for r in rows] == [(4, 3, 1), (3, 1, 2)]


def test_null_entity_in_neither_half_and_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,), (None,), (None,), ("c",)], "city string")
    train, test = leave_one_out(df, "a")
    assert (train.count(), test.count()) == (3, 2)
    assert [r["city"] for r in top_entities(df, "city", 2).collect()] == ["a", "b"]
    sizes = {r["city"]: (r["train_rows"], r["test_rows"]) for r in fold_sizes(df, "city", 3).collect()}
    assert sizes == {"a": (3, 2), "b": (3, 2), "c": (4, 1)}
