"""

Two panels come from the driver tables (FIXTURES.md):
``L`` — dirty station readings derived from ``lineitem`` (entity = supplier);
``E`` — the ``events`` table (entity ``user_id``, order ``ts, event_id``).
Every query reads the whole tables. Computed doubles are rounded to 6
decimals in both engines; quantiles use the exact form in both
(``percentile_approx`` with high accuracy = DuckDB ``quantile_disc``).
Model-fitting queries have no SQL form and get a rows-only check.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.audit import row_drop_audit
from panelcast.operators.calendar import calendar_features, calendar_target, daily_panel
from panelcast.operators.clean import (
    COLUMN_RENAMES,
    ENTITY_RENAME,
    POLLUTANTS,
    cast_numeric,
    drop_missing,
    parse_dates,
    rename_columns,
    select_existing,
)
from panelcast.operators.daily_stats import (
    Period,
    daily_stats,
    period_iqr_bounds,
    period_medians,
    period_moments,
    period_quantiles,
    read_daily_stats,
    write_daily_stats,
)
from panelcast.operators.entities import fold_sizes, top_entities
from panelcast.operators.evaluate import comparison_table, label_stats, regression_metrics
from panelcast.operators.features import (
    FEATURE_COLUMNS,
    LABEL_COL,
    cyclic_encoding,
    drop_incomplete,
    forecast_target,
    interactions,
    lag_features,
    panel_features,
    rolling_mean,
)
from panelcast.operators.impute import fill_values, fit_medians, medians_frame
from panelcast.operators.index import add_sub_indices, compute_aqi
from panelcast.operators.joins import asof_join, interval_join
from panelcast.operators.levels import metrics_by_levels, split_audit
from panelcast.operators.outliers import filter_iqr, filter_iqr_by_group, fit_iqr_bounds, iqr_bounds_frame, within
from panelcast.operators.sequences import fit_label_scaler, positional_split, sequence_windows
from panelcast.operators.split import (
    assign_split,
    cumulative_share,
    entity_date_split,
    fit_split,
    split_summary,
    year_counts,
)
from panelcast.panel import PanelSpec
from panelcast.sources.adapters import EVENTS_SPEC, READINGS_SPEC, events_panel, lineitem_readings
from panelcast.plans.pipeline import build_feature_table, run_preprocessing
from panelcast.sources.readings import RAW_COLUMNS, load_profile, read_readings, stage_dataset
from panelcast.streaming.panel import ROCKSDB, panel_feature_stream
from panelcast.sources.sinks import IMPORTANCE_SCHEMA, metrics_schema, preview, write_importance_csv, write_metrics_csv
from panelcast.session import scratch_path, staged

SMOKE_DIR = "/root/testdata/sf0.001"
KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
EKEYS = ["user_id", "ts", "event_id"]


def _r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- Spark side

def _readings(spark: SparkSession, d: str) -> DataFrame:
    """L, dealt to all cores where the file is fewer scan tasks: each scan task's rows to as many parts as there are cores."""
    cores = spark.sparkContext.defaultParallelism
    parts = spark.read.parquet(os.path.join(d, "lineitem.parquet")).rdd.getNumPartitions()
    return lineitem_readings(spark, d, cores * max(1, parts) if parts < cores else None)


def _clean(spark: SparkSession, d: str, drop_unparsed: bool = False, bind: bool = True) -> DataFrame:
    """L -> renamed, cast, dated (unparsed dates kept unless asked)."""
    raw = rename_columns(_readings(spark, d), {**COLUMN_RENAMES, **ENTITY_RENAME})
    return parse_dates(cast_numeric(raw), drop_unparsed=drop_unparsed, bind=bind)


def _indexed(spark: SparkSession, d: str, impute: bool = True) -> DataFrame:
    """Reference order: medians over all rows, then the index. The cleaned columns are
    staged (but for the texts no index or window reads), as every pass of the fits reads them."""
    if not impute:
        return compute_aqi(_clean(spark, d))
    df = staged(_clean(spark, d, bind=False).drop("spm", "date"), "clean")
    return compute_aqi(fill_values(df, fit_medians(df, POLLUTANTS)), bind=False)  # the concentrations are read from files


def _with_index(spark: SparkSession, d: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows that have an index, staged: bounds and windows read them several times. The index
    is worked out once; the filter reads it. ``columns`` are those staged (all, if not given)."""
    df = _indexed(spark, d)
    return drop_missing(staged(df if columns is None else df.select(*columns), "indexed"), "AQI")


#: What places a reading in the panel, and its index.
PANEL_COLUMNS = (*KEYS, "city", "date_parsed", "AQI")


def _readings_panel(spark: SparkSession, d: str, iqr: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """Imputed, indexed, (IQR-filtered,) dated rows of L."""
    df = _with_index(spark, d, columns)
    if iqr:
        df = filter_iqr(df, fit_iqr_bounds(df, "AQI"), "AQI")
    return df.filter(F.col("date_parsed").isNotNull())


def _feature_rows(spark: SparkSession, d: str, iqr: bool = True, **window_kw) -> DataFrame:
    feats = panel_features(_readings_panel(spark, d, iqr), READINGS_SPEC, "AQI", **window_kw)
    return drop_incomplete(interactions(cyclic_encoding(feats, "month")))


def _events_dated(spark: SparkSession, d: str) -> DataFrame:
    ev = events_panel(spark, d)
    return ev.withColumns({"date_parsed": F.to_date("ts"), "year": F.year("ts")})


def q_clean_tokens_cast(spark, d):
    df = rename_columns(lineitem_readings(spark, d), {**COLUMN_RENAMES, **ENTITY_RENAME})
    return cast_numeric(df).select(*KEYS, "city", "so2", "no2", "pm10", "pm2_5", "spm")


def q_parse_dates(spark, d):
    return _clean(spark, d, drop_unparsed=True).select(*KEYS, "date_parsed", "year", "month", "day")


def q_load_profile(spark, d):
    return load_profile(lineitem_readings(spark, d))


def q_median_values(spark, d):
    return medians_frame(_clean(spark, d), POLLUTANTS)


def q_impute_median(spark, d):
    df = _clean(spark, d)
    return fill_values(df, fit_medians(df, POLLUTANTS)).select(*KEYS, *POLLUTANTS)


def q_sub_index_each(spark, d):
    df = add_sub_indices(_clean(spark, d))
    return df.select(*KEYS, *[_r6(f"si_{k}").alias(f"si_{k}") for k in _SEGMENTS])


def q_aqi(spark, d):
    return _indexed(spark, d).select(*KEYS, _r6("AQI").alias("AQI"))


def q_drop_missing_aqi(spark, d):
    return drop_missing(_indexed(spark, d, impute=False), "AQI").select(*KEYS, _r6("AQI").alias("AQI"))


def q_iqr_bounds(spark, d):
    b = iqr_bounds_frame(_with_index(spark, d), "AQI", 1.5)
    return b.select(*[_r6(c).alias(c) for c in ("q1", "q3", "iqr", "lower", "upper")])


def q_iqr_bounds_by_entity(spark, d):
    b = iqr_bounds_frame(_with_index(spark, d), "AQI", 1.5, by="city")
    return b.select("city", *[_r6(c).alias(c) for c in ("q1", "q3", "iqr", "lower", "upper")])


def q_iqr_filter(spark, d):
    df = _with_index(spark, d)
    return filter_iqr(df, fit_iqr_bounds(df, "AQI"), "AQI").select(*KEYS, _r6("AQI").alias("AQI"))


def q_row_drop_audit(spark, d):
    df = _indexed(spark, d)
    bounds = fit_iqr_bounds(drop_missing(df, "AQI"), "AQI")
    return row_drop_audit(df, [
        ("aqi_not_null", F.col("AQI").isNotNull()),
        ("iqr_within", within("AQI", bounds)),
        ("date_parsed", F.col("date_parsed").isNotNull()),
    ])


def q_forecast_target_events(spark, d):
    df = forecast_target(events_panel(spark, d), EVENTS_SPEC, "value")
    return df.select(*EKEYS, "value", "value_target")


def q_forecast_target_readings(spark, d):
    df = forecast_target(_readings_panel(spark, d), READINGS_SPEC, "AQI")
    return df.select(*KEYS, "city", "date_parsed", _r6("AQI").alias("AQI"),
                     _r6("AQI_target").alias("AQI_target"))


def q_lag_features(spark, d):
    df = lag_features(events_panel(spark, d), EVENTS_SPEC, "value", (1, 24))
    return df.select(*EKEYS, "value_lag1", "value_lag24")


def q_rolling_mean(spark, d):
    df = rolling_mean(events_panel(spark, d), EVENTS_SPEC, "value", 24)
    return df.select(*EKEYS, _r6("value_rolling_24").alias("value_rolling_24"))


def q_cyclic_encoding(spark, d):
    df = cyclic_encoding(_clean(spark, d, drop_unparsed=True), "month")
    return df.select(*KEYS, "month", _r6("month_sin").alias("month_sin"), _r6("month_cos").alias("month_cos"))


def q_interactions(spark, d):
    df = _clean(spark, d)
    df = interactions(fill_values(df, fit_medians(df, POLLUTANTS)))
    return df.select(*KEYS, _r6("pm25_x_so2").alias("pm25_x_so2"), _r6("no2_x_pm10").alias("no2_x_pm10"))


def q_feature_table(spark, d):
    df = build_feature_table(_readings(spark, d), READINGS_SPEC, compat=True)[0]
    return df.select(*KEYS, "city", "date_parsed", *[_r6(c).alias(c) for c in (*FEATURE_COLUMNS, LABEL_COL)])


def q_feature_table_chunked(spark, d):
    """The feature table through the skew-safe plan: every entity is cut into
    100-row chunks with a 24-row look-back / 1-row look-ahead halo."""
    df = _feature_rows(spark, d, iqr=True, strategy="chunked", chunk_rows=100)
    return df.select(*KEYS, "city", "date_parsed", *[_r6(c).alias(c) for c in (*FEATURE_COLUMNS, LABEL_COL)])


def q_panel_features_chunked(spark, d):
    """Lead, lags and rolling mean on events through 25-row chunks."""
    df = panel_features(events_panel(spark, d), EVENTS_SPEC, "value", strategy="chunked", chunk_rows=25)
    return df.select(*EKEYS, "value_target", "value_lag1", "value_lag24",
                     _r6("value_rolling_24").alias("value_rolling_24"))


def q_year_counts(spark, d):
    return year_counts(_clean(spark, d, drop_unparsed=True)).select("year", "rows")


def q_cumulative_share(spark, d):
    cs = cumulative_share(_clean(spark, d, drop_unparsed=True))
    return cs.select("year", "rows", "cum_rows", _r6("cum_share").alias("cum_share"),
                     F.col("year_idx").cast("long").alias("year_idx"),
                     F.col("n_years").cast("long").alias("n_years"))


def _split_report(df):
    s = split_summary(df, "split", "date_parsed")
    return s.select("split", "rows", _r6("share").alias("share"), "first_date", "last_date")


def q_chrono_split_years(spark, d):
    df = _clean(spark, d, drop_unparsed=True)
    return _split_report(assign_split(df, fit_split(df, 0.8, 2)))


def q_chrono_split_date(spark, d):
    df = _events_dated(spark, d)
    return _split_report(assign_split(df, fit_split(df, 0.8, 2)))


def q_calendar_target(spark, d):
    daily = daily_panel(_readings_panel(spark, d, columns=PANEL_COLUMNS), "city", "date_parsed", ["AQI"], "avg")
    out = calendar_target(daily, "city", "date_parsed", "AQI", days=1)
    return out.select("city", "date_parsed", _r6("AQI").alias("AQI"), "readings",
                      _r6("AQI_target_1d").alias("AQI_target_1d"))


def q_entity_date_split(spark, d):
    out = entity_date_split(_events_dated(spark, d), "user_id", 0.8)
    return out.groupBy("user_id", "split").agg(F.count(F.lit(1)).alias("rows"))


def q_top_entities(spark, d):
    return top_entities(_clean(spark, d, drop_unparsed=True), "city", 3)


def q_leave_one_out_counts(spark, d):
    return fold_sizes(_clean(spark, d, drop_unparsed=True), "city", 3)


def q_label_stats(spark, d):
    df = forecast_target(_readings_panel(spark, d), READINGS_SPEC, "AQI")
    return label_stats(df, LABEL_COL).select(*[_r6(c).alias(c) for c in ("mean", "std", "min", "max")], "n")


def _persistence(spark, d):
    return forecast_target(events_panel(spark, d), EVENTS_SPEC, "value").withColumnRenamed("value", "prediction")


def q_regression_metrics(spark, d):
    m = regression_metrics(_persistence(spark, d), "value_target", "prediction")
    return m.select(*[_r6(c).alias(c) for c in ("RMSE", "MAE", "MAPE", "R2")], "n")


def q_regression_metrics_by_entity(spark, d):
    m = regression_metrics(_persistence(spark, d), "value_target", "prediction", by="user_id")
    return m.select("user_id", *[_r6(c).alias(c) for c in ("RMSE", "MAE", "MAPE", "R2")], "n")


def q_scaled_features(spark, d):
    from pyspark.ml.functions import vector_to_array

    from panelcast.plans.models import fit_features
    feats = staged(_feature_rows(spark, d, iqr=True).select(*KEYS, *FEATURE_COLUMNS), "features")
    scaled = fit_features(feats, FEATURE_COLUMNS, scale=True).transform(feats)
    arr = vector_to_array("features")
    return scaled.select(*KEYS, *[_r6(arr[i]).alias(f"z_{c}") for i, c in enumerate(FEATURE_COLUMNS)])


def q_label_scaling(spark, d):
    df = staged(forecast_target(_readings_panel(spark, d, columns=PANEL_COLUMNS), READINGS_SPEC, "AQI").select(*KEYS, LABEL_COL), "labels")
    scaler = fit_label_scaler(df, LABEL_COL)
    z = scaler.scale(LABEL_COL)
    return df.select(*KEYS, _r6(z).alias("y_scaled"), _r6(scaler.unscale(z)).alias("y_restored"))


def q_sequence_windows(spark, d):
    seq = sequence_windows(events_panel(spark, d), EVENTS_SPEC, ["value"], "value", 24, dtype="double")
    first, last = F.col("seq")[0][0], F.col("seq")[23][0]
    total = F.aggregate(F.col("seq"), F.lit(0.0), lambda acc, x: acc + x[0])
    return seq.select(*EKEYS, F.size("seq").alias("seq_len"), first.alias("seq_first"),
                      last.alias("seq_last"), _r6(total).alias("seq_sum"))


def q_positional_split(spark, d):
    return positional_split(events_panel(spark, d), EVENTS_SPEC, 0.8).select(*EKEYS, "split")


def q_ols_one_feature(spark, d):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    df = staged(forecast_target(_readings_panel(spark, d, columns=PANEL_COLUMNS), READINGS_SPEC, "AQI").select("AQI", LABEL_COL), "one-column")
    vec = VectorAssembler(inputCols=["AQI"], outputCol="x").transform(df)
    m = LinearRegression(featuresCol="x", labelCol=LABEL_COL, regParam=0.0, solver="normal").fit(vec)
    return spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))],
                                 "slope double, intercept double").select(
        _r6("slope").alias("slope"), _r6("intercept").alias("intercept"))


def _model_run(spark, d, models, params=None, include_sequence=False):
    from panelcast.plans.pipeline import run_forecast
    return run_forecast(_readings(spark, d), READINGS_SPEC, compat=False, models=models, params=params,
                        include_sequence=include_sequence)


def q_linear_metrics(spark, d):
    return _model_run(spark, d, ("LinearRegression",)).metrics


def q_forest_metrics(spark, d):
    return _model_run(spark, d, ("RandomForest",)).metrics


def q_gbt_metrics(spark, d):
    return _model_run(spark, d, ("GBTRegressor",)).metrics


def q_model_comparison(spark, d):
    from panelcast.plans.pipeline import run_forecast
    res = run_forecast(_readings(spark, d), READINGS_SPEC, compat=True)
    return res.metrics


def q_feature_importance(spark, d):
    return _model_run(spark, d, ("RandomForest",)).importance


def q_cross_entity_validation(spark, d):
    from panelcast.plans.crossval import cross_entity_forecast
    return cross_entity_forecast(_clean(spark, d, drop_unparsed=True), READINGS_SPEC, 3)


def q_sequence_regression(spark, d):
    res = _model_run(spark, d, ("LinearRegression",), include_sequence=True)
    return res.metrics.filter(F.col("model") == "SequenceLinear")


def q_stage_dataset(spark, d):
    staged = stage_dataset(lineitem_readings(spark, d), scratch_path(spark, "staged_readings"))
    return staged.groupBy(F.col("year").cast("int").alias("year")).agg(F.count(F.lit(1)).alias("rows"))


def q_metrics_roundtrip(spark, d):
    m = regression_metrics(_persistence(spark, d), "value_target", "prediction")
    m = m.select(F.lit("Persistence").alias("model"), "RMSE", "MAE", "MAPE", "R2",
                 F.lit(0.0).alias("training_time_sec"))
    path = scratch_path(spark, "metrics_csv")
    write_metrics_csv(m, path)
    back = spark.read.schema(metrics_schema()).option("header", True).csv(path)
    return back.select("model", *[_r6(c).alias(c) for c in ("RMSE", "MAE", "MAPE", "R2", "training_time_sec")])


def q_metrics_by_entity_roundtrip(spark, d):
    m = regression_metrics(_persistence(spark, d), "value_target", "prediction", by="user_id")
    m = m.select(F.concat(F.lit("Persistence_"), "user_id").alias("model"), "RMSE", "MAE", "MAPE", "R2",
                 F.lit(0.0).alias("training_time_sec"), F.col("user_id").cast("string").alias("user_id"))
    path = scratch_path(spark, "entity_metrics_csv")
    write_metrics_csv(m, path)
    back = spark.read.schema(metrics_schema("user_id")).option("header", True).csv(path)
    return back.select("model", "user_id", *[_r6(c).alias(c) for c in ("RMSE", "MAE", "MAPE", "R2")])


def q_importance_roundtrip(spark, d):
    """S5/K3 on the share of readings that have each concentration."""
    shares = _clean(spark, d).agg(*[(F.count(c) / F.count(F.lit(1))).alias(c) for c in POLLUTANTS])
    path = scratch_path(spark, "importance_csv")
    write_importance_csv(shares.unpivot([], list(POLLUTANTS), "feature", "importance"), path)
    return spark.read.schema(IMPORTANCE_SCHEMA).option("header", True).csv(path)


def q_comparison_persistence(spark, d):
    m = regression_metrics(_persistence(spark, d), "value_target", "prediction")
    return comparison_table(m.withColumns({"model": F.lit("Persistence"), "training_time_sec": F.lit(0.0)}))


def q_preview(spark, d):
    df = _clean(spark, d, drop_unparsed=True).orderBy(*KEYS)
    return preview(df, [*KEYS, "city", "date_parsed", "no_such_column"])


def q_select_existing(spark, d):
    return select_existing(_clean(spark, d), [*KEYS, "no_such_column", "spm", "city"])


def q_csv_scan(spark, d):
    """Readings written as CSV with the columns in reverse order, read back by name."""
    df = lineitem_readings(spark, d)
    df = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in reversed(RAW_COLUMNS)])
    path = scratch_path(spark, "readings_csv")
    (df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return read_readings(spark, ["hdfs://no-such-host.invalid/readings.csv", path]).select("location", "so2", "no2", "rspm", "spm", "pm2_5", "date")


def q_csv_folder(spark, d):
    """A folder of station files of three layouts: columns in order, in reverse, and without ``spm``."""
    df = lineitem_readings(spark, d).withColumn("stn_code", F.concat_ws("-", *KEYS))
    df = df.select("l_orderkey", *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in RAW_COLUMNS])
    path = scratch_path(spark, "station_files")
    layouts = (RAW_COLUMNS, RAW_COLUMNS[::-1], [c for c in RAW_COLUMNS if c != "spm"])
    for i, names in enumerate(layouts):
        part = df.filter(F.col("l_orderkey") % 3 == i).select(*names)
        part.write.mode("append").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return read_readings(spark, path, missing="null").select("stn_code", "location", "so2", "no2", "rspm", "spm", "pm2_5", "date")


def q_aqi_gap_round(spark, d):
    df = _clean(spark, d)
    df = compute_aqi(fill_values(df, fit_medians(df, POLLUTANTS)), gap_policy="round")
    return df.select(*KEYS, _r6("AQI").alias("AQI"))


def q_iqr_filter_by_entity(spark, d):
    df = filter_iqr_by_group(_with_index(spark, d), "AQI", "city")
    return df.select(*KEYS, _r6("AQI").alias("AQI"))


def _hot(key: str):
    return F.when(F.col(key) % 3 != 0, F.lit("hot")).when(F.col(key) % 6 == 0, F.lit("cold"))


def q_iqr_bounds_hot_entity(spark, d):
    """Three groups, one with two thirds of all rows, one of them null."""
    df = _with_index(spark, d).withColumn("part", _hot("l_orderkey"))
    b = iqr_bounds_frame(df, "AQI", 1.5, by="part")
    return b.select("part", *[_r6(c).alias(c) for c in ("q1", "q3", "iqr", "lower", "upper")])


def q_entity_date_split_hot(spark, d):
    """The null entity is in neither half."""
    df = _events_dated(spark, d).withColumn("part", _hot("event_id"))
    return entity_date_split(df, "part", 0.8).groupBy("part", "split").agg(F.count(F.lit(1)).alias("rows"))


def q_sequence_windows_offset(spark, d):
    """Windows that end with the current row."""
    seq = sequence_windows(events_panel(spark, d), EVENTS_SPEC, ["value"], "value", 24, dtype="double", offset=0)
    total = F.aggregate(F.col("seq"), F.lit(0.0), lambda acc, x: acc + x[0])
    return seq.select(*EKEYS, F.col("seq")[0][0].alias("seq_first"), F.col("seq")[23][0].alias("seq_last"), _r6(total).alias("seq_sum"))


def q_chunked_one_day(spark, d):
    """One entity, one day: the order within the day is all there is."""
    ev = events_panel(spark, d).withColumns({"one": F.lit("x"), "day": F.lit("2024-01-01").cast("date")})
    spec = PanelSpec("one", "day", ("event_id",))
    out = panel_features(ev, spec, "value", strategy="chunked", chunk_rows=500)
    return out.select("event_id", "value_target", "value_lag1", "value_lag24", _r6("value_rolling_24").alias("value_rolling_24"))


def q_preprocessed_table(spark, d):
    df = run_preprocessing(_readings(spark, d))
    return df.select(*KEYS, "city", "date_parsed", "year", "month", "day", "so2", "no2", "pm10", "pm2_5", _r6("AQI").alias("AQI"))


def q_leak_free_features(spark, d):
    df = build_feature_table(_readings(spark, d), READINGS_SPEC)[0]
    return df.select(*KEYS, "city", "date_parsed", "split", "is_outlier", *[_r6(c).alias(c) for c in (*FEATURE_COLUMNS, LABEL_COL)])


def q_assembled_features(spark, d):
    """Assembled without scaling."""
    from pyspark.ml.functions import vector_to_array

    from panelcast.plans.models import fit_features
    feats = _feature_rows(spark, d)
    arr = vector_to_array("features")
    out = fit_features(feats, FEATURE_COLUMNS, scale=False).transform(feats)
    return out.select(*KEYS, *[_r6(arr[i]).alias(f"x_{c}") for i, c in enumerate(FEATURE_COLUMNS)])


def _month_vectors(spark, d):
    """Staged: the fits and the predictions each read them several times."""
    from panelcast.plans.models import fit_features
    df = forecast_target(_readings_panel(spark, d, columns=(*PANEL_COLUMNS, "month")), READINGS_SPEC, "AQI").select("month", LABEL_COL)
    return staged(fit_features(df, ["month"], scale=False).transform(df), "month-vectors")


def _stump(spark, d, name, **params):
    """What a depth-1 tree predicts for each month: both leaves are means of the best split."""
    from panelcast.plans.models import train_models
    df = _month_vectors(spark, d)
    model, _ = train_models(df, [name], params={name: params})[name]
    months = df.select("month", "features").distinct()
    return model.transform(months).select("month", _r6("prediction").alias("prediction"))


def q_forest_one_split(spark, d):
    return _stump(spark, d, "RandomForest", numTrees=1, maxDepth=1, bootstrap=False, featureSubsetStrategy="all", subsamplingRate=1.0)


def q_gbt_one_split(spark, d):
    return _stump(spark, d, "GBTRegressor", maxIter=1, maxDepth=1)


def q_ols_two_features(spark, d):
    from panelcast.plans.models import fit_features, linear_coefficients, train_models
    cols = ["month", "day"]
    df = staged(forecast_target(_readings_panel(spark, d), READINGS_SPEC, "AQI").select(*cols, LABEL_COL), "two-columns")
    df = fit_features(df, cols, scale=False).transform(df)
    model, _ = train_models(df, ["LinearRegression"], params={"LinearRegression": {"regParam": 0.0, "solver": "normal"}})["LinearRegression"]
    return linear_coefficients(spark, model, cols).select("feature", _r6("coefficient").alias("coefficient"))


def q_sequence_ols(spark, d):
    """Windows of one row that end with the current one: the sequence model is the plain regression."""
    from panelcast.plans.models import fit_sequence_regression
    df = forecast_target(_readings_panel(spark, d), READINGS_SPEC, "AQI").select(*KEYS, "city", "date_parsed", "AQI", LABEL_COL)
    seq = sequence_windows(staged(df, "labels"), READINGS_SPEC, ["AQI"], LABEL_COL, 1, dtype="double", offset=0)
    seq = staged(seq.select("seq", LABEL_COL), "sequences")  # the scaler and the fit read them
    scaler = fit_label_scaler(seq, LABEL_COL)
    model, _ = fit_sequence_regression(seq.withColumn("_y", scaler.scale(LABEL_COL)), "_y", regParam=0.0, solver="normal")
    row = [(float(model.coefficients[0]), float(model.intercept))]
    out = spark.createDataFrame(row, "b double, a double")
    return out.select(_r6(F.col("b") * scaler.std).alias("slope"), _r6(scaler.unscale("a")).alias("intercept"))


def q_cross_entity_ols(spark, d):
    """Folds of one-feature regressions; medians and outlier bounds are the training entities' own."""
    from panelcast.plans.crossval import cross_entity_forecast
    out = cross_entity_forecast(_clean(spark, d, drop_unparsed=True), READINGS_SPEC, 3, "LinearRegression", ["AQI_lag1"], scale=False,
                                params={"regParam": 0.0, "solver": "normal"})
    return out.select("city", *[_r6(c).alias(c) for c in ("RMSE", "MAE")], "n")


def q_calendar_features(spark, d):
    """Calendar lags and rolling means of every event, per user."""
    out = calendar_features(events_panel(spark, d), "user_id", "ts", "value", (1, 24), (24,), block_days=7)
    # means of some 2-decimal values end in a 5 at the seventh decimal; nine keep clear of such ties
    return out.select("event_id", *[F.round(c, 9).alias(c) for c in ("value_lag1d", "value_lag24d", "value_rolling_24d")])


def q_calendar_features_hot(spark, d):
    """The same where one entity holds two thirds of all rows and one is null."""
    ev = events_panel(spark, d).withColumn("part", _hot("event_id"))
    out = calendar_features(ev, "part", "ts", "value", (1, 24), (24,))
    # means of some 2-decimal values end in a 5 at the seventh decimal; nine keep clear of such ties
    return out.select("event_id", *[F.round(c, 9).alias(c) for c in ("value_lag1d", "value_lag24d", "value_rolling_24d")])


def _files_a_batch(sizes: list[int]) -> int:
    """Files every micro-batch is written as, about a million rows each in the largest. A trigger takes this number, so no
    batch may have fewer: rows are dealt in turn, and the smallest batch has thousands for each file."""
    return max(1, min(-(-max(sizes, default=0) // 1_000_000), min(sizes, default=0) // 10_000))


def q_stream_panel_features(spark, d):
    """Events arriving up to a day late, in micro-batches of six days, through the stateful stream. A last row of
    another user moves the watermark past all others."""
    store = "spark.sql.streaming.stateStore.providerClass"
    ev = events_panel(spark, d).select("user_id", "ts", "event_id", "value")
    late = F.pmod(F.xxhash64("event_id"), F.lit(86_400))
    ev = ev.withColumn("batch", F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) + late) / (6 * 86_400)))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit("2200-01-01").cast("timestamp_ntz").alias("ts"),
                                F.lit(-1).cast("long").alias("event_id"), F.lit(0.0).alias("value"))
    src, state, out = (scratch_path(spark, n) for n in ("stream-in", "stream-state", "stream-out"))
    ev = ev.filter(F.col("batch").isNotNull())  # rows without a time have no place in the stream
    sizes = ev.groupBy("batch").count().orderBy("batch").collect()  # one a six days
    files = _files_a_batch([r["count"] for r in sizes])
    for batch, _ in sizes:
        part = ev.filter(F.col("batch") == batch).drop("batch")
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(src)
    end.write.mode("append").parquet(src)
    before = spark.conf.get(store)
    spark.conf.set(store, ROCKSDB)
    try:
        stream = spark.readStream.schema(end.schema).option("maxFilesPerTrigger", files).parquet(src)
        made = panel_feature_stream(stream, EVENTS_SPEC, "value", "1 day")
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before)
    return spark.read.schema(made.schema).parquet(out).select(*EKEYS, "value", "value_target", "value_lag1", "value_lag24", _r6("value_rolling_24").alias("value_rolling_24"))


def _last_views(ev: DataFrame, key: str) -> DataFrame:
    views = ev.filter("event_type = 'view'").select(key, "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    out = asof_join(ev, views, key, "ts", ties=["view_id"], exact=False, chunk_rows=2_000)
    return out.select("event_id", "view_id", "view_value")


def q_asof_join(spark, d):
    """The last view of the same user before each event."""
    return _last_views(events_panel(spark, d), "user_id")


def q_asof_join_hot(spark, d):
    """The same by a key that holds two thirds of all rows, and null for some."""
    return _last_views(events_panel(spark, d).withColumn("part", _hot("event_id")), "part")


def q_asof_join_forward(spark, d):
    """The first purchase of the same user at or after each event."""
    ev = events_panel(spark, d)
    bought = ev.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    return asof_join(ev, bought, "user_id", "ts", ties=["purchase_id"], direction="forward").select("event_id", "purchase_id")


def _spans(ev: DataFrame, key: str) -> DataFrame:
    """Spans of some hours from every signup on, one in eleven of 20 days."""
    hours = F.when(F.col("event_id") % 11 == 0, 480).otherwise(1 + F.col("event_id") % 7).cast("int")
    return ev.filter("event_type = 'signup'").select(key, F.col("event_id").alias("span_id"), F.col("ts").alias("lo"),
                                                     F.timestamp_add("HOUR", hours, F.col("ts")).alias("hi"))


def q_interval_join(spark, d):
    ev = events_panel(spark, d)
    return interval_join(ev, _spans(ev, "user_id"), "user_id", "ts", "lo", "hi").select("event_id", "span_id")


def q_interval_join_hot(spark, d):
    """Events within the spans of their part, one part with two thirds of all rows: counted per event."""
    ev = events_panel(spark, d).withColumn("part", _hot("event_id"))
    met = interval_join(ev, _spans(ev, "part"), "part", "ts", "lo", "hi", cell_rows=1_000, totals={"spans": None, "span_sum": "span_id"})
    return met.groupBy("event_id").agg(F.sum("spans").alias("spans"), F.sum("span_sum").alias("span_sum"))


_PERIODS = (Period("all"), Period("to 1997", None, dt.date(1997, 12, 31)), Period("1997 and 1998", dt.date(1997, 1, 1), dt.date(1998, 12, 31)))
_STATED = (*POLLUTANTS, "AQI")


def _stated(spark, d):
    """Rows with an index and the path of their daily states, appended in three parts."""
    df, path = _with_index(spark, d), scratch_path(spark, "daily-stats")
    for k in range(3):
        write_daily_stats(daily_stats(df.filter(F.col("l_orderkey") % 3 == k), "date_parsed", _STATED), path)
    return df, path


def q_period_moments(spark, d):
    """A10 for three periods, from the stored states alone."""
    out = period_moments(read_daily_stats(spark, _stated(spark, d)[1], _PERIODS), _PERIODS)
    return out.select("period", "column", "n", "missing", *[_r6(c).alias(c) for c in ("mean", "std", "min", "max")])


def q_period_quantiles(spark, d):
    """Quartiles of three periods within 1 %, from the stored states alone."""
    out = period_quantiles(read_daily_stats(spark, _stated(spark, d)[1], _PERIODS), _PERIODS, (0.25, 0.5, 0.75))
    return out.select("period", "column", "prob", *[_r6(c).alias(c) for c in ("value", "low", "high")], "rank", "below")


def q_period_fits(spark, d):
    """A1 to A3 for three periods: exact medians and bounds that start from the stored states."""
    df, path = _stated(spark, d)
    made = []
    for p in _PERIODS:
        stats = read_daily_stats(spark, path, [p])
        medians, b = period_medians(df, "date_parsed", stats, p, POLLUTANTS), period_iqr_bounds(df, "date_parsed", stats, p)
        made.append((p.name, *[medians.get(c) for c in POLLUTANTS], *((b.lower, b.upper) if b else (None, None))))
    out = spark.createDataFrame(made, "period string, " + ", ".join(f"{c} double" for c in (*POLLUTANTS, "lower", "upper")))
    return out.select("period", *POLLUTANTS, _r6("lower").alias("lower"), _r6("upper").alias("upper"))


def q_evaluate_one_column(spark, d):
    """M8, M9: the three models of a single column through training and evaluation, every row scored."""
    from panelcast.operators.evaluate import evaluate_models
    from panelcast.plans.models import train_models
    df = _month_vectors(spark, d)
    params = {"LinearRegression": {"regParam": 0.0, "solver": "normal"}, "GBTRegressor": {"maxIter": 1, "maxDepth": 1},
              "RandomForest": {"numTrees": 1, "maxDepth": 1, "bootstrap": False, "featureSubsetStrategy": "all", "subsamplingRate": 1.0}}
    out = evaluate_models(train_models(df, list(params), params=params), df)
    return out.select("model", *[_r6(c).alias(c) for c in ("RMSE", "MAE", "MAPE", "R2")], "n")


def q_importance_ranked(spark, d):
    """Importances of a depth-1 tree over two columns, with their rank."""
    from panelcast.plans.models import feature_importance, fit_features, train_models
    cols = ["month", "day"]
    df = forecast_target(_readings_panel(spark, d), READINGS_SPEC, "AQI").select(*cols, LABEL_COL)
    df = staged(fit_features(df, cols, scale=False).transform(df), "two-columns")
    params = {"RandomForest": {"numTrees": 1, "maxDepth": 1, "bootstrap": False, "featureSubsetStrategy": "all", "subsamplingRate": 1.0}}
    model, _ = train_models(df, ["RandomForest"], params=params)["RandomForest"]
    ranked = [(i + 1, r["feature"], r["importance"]) for i, r in enumerate(feature_importance(spark, model, cols).collect())]  # a row a feature, in order
    return spark.createDataFrame(ranked, "rank int, feature string, importance double").withColumn("importance", _r6("importance"))


def q_elastic_net_one_feature(spark, d):
    """M3 with its default penalties on one standardised column."""
    from panelcast.plans.models import fit_features, train_models
    df = staged(forecast_target(_readings_panel(spark, d, columns=PANEL_COLUMNS), READINGS_SPEC, "AQI").select("AQI", LABEL_COL), "labels")
    df = staged(fit_features(df, ["AQI"], scale=True).transform(df), "one-column")
    model, _ = train_models(df, ["LinearRegression"], params={"LinearRegression": {"tol": 1e-12, "maxIter": 500}})["LinearRegression"]
    return spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "coefficient double, intercept double").select(
        F.round("coefficient", 4).alias("coefficient"), F.round("intercept", 4).alias("intercept"))


def q_metrics_by_levels(spark, d):
    """Metrics by (user, day of the week), by user, by event type and over all, in one pass."""
    df = _persistence(spark, d).withColumn("weekday", F.dayofweek("ts"))
    out = metrics_by_levels(df, [("user_id", "weekday"), ("user_id",), ("event_type",), ()], "value_target", "prediction")
    return out.select("level", "user_id", "weekday", "event_type", *[_r6(c).alias(c) for c in ("RMSE", "MAE", "MAPE", "R2")], "n")


def q_split_audit(spark, d):
    """Rows that both halves of the split hold, as multisets: nulls and repeated rows included."""
    df = _clean(spark, d)
    df = df.withColumn("half", F.when(F.col("l_orderkey") % 2 == 0, "a").otherwise("b"))
    cols = ["city", "month", "so2", "no2"]
    return split_audit(df.filter("half = 'a'"), df.filter("half = 'b'"), cols)


def q_sql_functions(spark, d):
    """The index through SQL alone: registered functions over a view of the raw readings."""
    from panelcast.functions.sql import register
    register(spark)
    staged(_readings(spark, d).select(*KEYS, "so2", "no2", "rspm", "pm2_5", "date"), "raw-readings").createOrReplaceTempView("raw_readings")
    return spark.sql("""
        SELECT l_orderkey, l_linenumber, l_partkey, round(aqi(number_of(so2), number_of(no2), number_of(rspm), number_of(pm2_5)), 6) AS AQI,
               split_label(CAST(l_orderkey % 10 AS INT), 7) AS part FROM raw_readings""")


def q_sql_breakpoints(spark, d):
    """Readings of pm10 per segment of its breakpoints, by the table function."""
    from panelcast.functions.sql import register
    register(spark)
    staged(_clean(spark, d).select("pm10"), "pm10").createOrReplaceTempView("pm10_readings")
    return spark.sql("""SELECT b.low, b.high, count(r.pm10) AS readings FROM breakpoints('pm10') b
        LEFT JOIN pm10_readings r ON r.pm10 >= b.low AND r.pm10 <= b.high GROUP BY b.low, b.high""")


def _documents(spark, d):
    """Readings as JSON text; one in thirteen is cut off."""
    raw = lineitem_readings(spark, d)
    text = F.to_json(F.struct("location", "date", F.create_map(*[x for c in ("so2", "no2", "pm2_5") for x in (F.lit(c), F.col(c))]).alias("readings")))
    return raw.select(*KEYS, F.when(F.col("l_orderkey") % 13 == 0, F.substring(text, 1, 25)).otherwise(text).alias("document"))


def q_json_readings(spark, d):
    from panelcast.sources.documents import json_readings
    return json_readings(_documents(spark, d), pollutants=["so2", "no2", "pm2_5"])


def q_json_document_counts(spark, d):
    from panelcast.sources.documents import document_counts, json_readings
    return document_counts(json_readings(_documents(spark, d)))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "metrics_by_levels": q_metrics_by_levels,
    "split_audit": q_split_audit,
    "sql_functions": q_sql_functions,
    "sql_breakpoints": q_sql_breakpoints,
    "json_readings": q_json_readings,
    "json_document_counts": q_json_document_counts,
    "evaluate_one_column": q_evaluate_one_column,
    "importance_ranked": q_importance_ranked,
    "elastic_net_one_feature": q_elastic_net_one_feature,
    "asof_join": q_asof_join,
    "asof_join_hot": q_asof_join_hot,
    "asof_join_forward": q_asof_join_forward,
    "interval_join": q_interval_join,
    "interval_join_hot": q_interval_join_hot,
    "stream_panel_features": q_stream_panel_features,
    "calendar_features": q_calendar_features,
    "calendar_features_hot": q_calendar_features_hot,
    "clean_tokens_cast": q_clean_tokens_cast,
    "parse_dates": q_parse_dates,
    "load_profile": q_load_profile,
    "median_values": q_median_values,
    "impute_median": q_impute_median,
    "sub_index_each": q_sub_index_each,
    "aqi": q_aqi,
    "drop_missing_aqi": q_drop_missing_aqi,
    "iqr_bounds": q_iqr_bounds,
    "iqr_bounds_by_entity": q_iqr_bounds_by_entity,
    "period_moments": q_period_moments,
    "period_quantiles": q_period_quantiles,
    "period_fits": q_period_fits,
    "iqr_filter": q_iqr_filter,
    "row_drop_audit": q_row_drop_audit,
    "forecast_target_events": q_forecast_target_events,
    "forecast_target_readings": q_forecast_target_readings,
    "lag_features": q_lag_features,
    "rolling_mean": q_rolling_mean,
    "cyclic_encoding": q_cyclic_encoding,
    "interactions": q_interactions,
    "feature_table": q_feature_table,
    "feature_table_chunked": q_feature_table_chunked,
    "panel_features_chunked": q_panel_features_chunked,
    "year_counts": q_year_counts,
    "cumulative_share": q_cumulative_share,
    "chrono_split_years": q_chrono_split_years,
    "chrono_split_date": q_chrono_split_date,
    "calendar_target": q_calendar_target,
    "entity_date_split": q_entity_date_split,
    "top_entities": q_top_entities,
    "leave_one_out_counts": q_leave_one_out_counts,
    "label_stats": q_label_stats,
    "regression_metrics": q_regression_metrics,
    "regression_metrics_by_entity": q_regression_metrics_by_entity,
    "scaled_features": q_scaled_features,
    "label_scaling": q_label_scaling,
    "sequence_windows": q_sequence_windows,
    "positional_split": q_positional_split,
    "ols_one_feature": q_ols_one_feature,
    "stage_dataset": q_stage_dataset,
    "linear_metrics": q_linear_metrics,
    "forest_metrics": q_forest_metrics,
    "gbt_metrics": q_gbt_metrics,
    "model_comparison": q_model_comparison,
    "feature_importance": q_feature_importance,
    "cross_entity_validation": q_cross_entity_validation,
    "sequence_regression": q_sequence_regression,
    "metrics_roundtrip": q_metrics_roundtrip,
    "metrics_by_entity_roundtrip": q_metrics_by_entity_roundtrip,
    "importance_roundtrip": q_importance_roundtrip,
    "comparison_persistence": q_comparison_persistence,
    "preview": q_preview,
    "select_existing": q_select_existing,
    "csv_scan": q_csv_scan,
    "csv_folder": q_csv_folder,
    "aqi_gap_round": q_aqi_gap_round,
    "iqr_filter_by_entity": q_iqr_filter_by_entity,
    "iqr_bounds_hot_entity": q_iqr_bounds_hot_entity,
    "entity_date_split_hot": q_entity_date_split_hot,
    "sequence_windows_offset": q_sequence_windows_offset,
    "chunked_one_day": q_chunked_one_day,
    "preprocessed_table": q_preprocessed_table,
    "leak_free_features": q_leak_free_features,
    "assembled_features": q_assembled_features,
    "forest_one_split": q_forest_one_split,
    "gbt_one_split": q_gbt_one_split,
    "ols_two_features": q_ols_two_features,
    "sequence_ols": q_sequence_ols,
    "cross_entity_ols": q_cross_entity_ols,
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: full leak-free run on sf0.001 (features -> split -> linear model metrics)."""
    from panelcast.plans.pipeline import run_forecast
    res = run_forecast(lineitem_readings(spark, SMOKE_DIR), READINGS_SPEC,
                       models=("LinearRegression",))
    return res.metrics


def _llm() -> tuple[dict, dict]:
    """Queries and SQL of the optional subpackage and its pipeline, where they are installed."""
    try:
        import corpus_pipeline
        from panelcast.llm.queries import ORACLE, QUERIES
    except ModuleNotFoundError as e:
        if not (e.name or "").startswith(("panelcast.llm", "corpus_pipeline")):
            raise
        return {}, {}
    sql = dict(ORACLE) if corpus_pipeline.ORACLE_SQL is None else {**ORACLE, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {**QUERIES, "pipeline": corpus_pipeline.run}, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_QUERIES, **_llm()[0]}


# ---------------------------------------------------------------- SQL side

def _tok_sql(r: int, e: str) -> str:
    return (f"CASE WHEN l_orderkey % 11 = {r} THEN 'NA' WHEN l_orderkey % 13 = {r} THEN ' none ' "
            f"WHEN l_orderkey % 17 = {r} THEN '' ELSE CAST({e} AS VARCHAR) END")


def _nt(x: str) -> str:
    return f"CASE WHEN upper(trim({x})) IN ('', 'NA', 'NONE') THEN NULL ELSE {x} END"


def _half(e: str) -> str:
    return f"CAST(floor({e} * 2) AS DOUBLE) / 2.0"


# Fixed values, stated here apart from the package: published breakpoints as (BPlo, BPhi, Ilo, Ihi).
_SEGMENTS = {
    "pm2_5": [(0, 30, 0, 50), (31, 60, 51, 100), (61, 90, 101, 200), (91, 120, 201, 300), (121, 250, 301, 400), (250, 500, 401, 500)],
    "pm10": [(0, 50, 0, 50), (51, 100, 51, 100), (101, 250, 101, 200), (251, 350, 201, 300), (351, 430, 301, 400), (430, 600, 401, 500)],
    "so2": [(0, 40, 0, 50), (41, 80, 51, 100), (81, 380, 101, 200), (381, 800, 201, 300), (801, 1600, 301, 400), (1600, 2400, 401, 500)],
    "no2": [(0, 40, 0, 50), (41, 80, 51, 100), (81, 180, 101, 200), (181, 280, 201, 300), (281, 400, 301, 400), (400, 600, 401, 500)],
}
# The model inputs and the label.
_INPUTS = ("so2", "no2", "pm10", "pm2_5", "month", "day", "AQI_lag1", "AQI_lag24", "AQI_rolling_24",
           "month_sin", "month_cos", "pm25_x_so2", "no2_x_pm10")
_LABEL = "AQI_target"


def _si_sql(x: str, table) -> str:
    parts = [f"WHEN isnan({x}) THEN NULL"]
    for lo, hi, ilo, ihi in table:
        parts.append(f"WHEN {x} >= {lo} AND {x} <= {hi} THEN {ilo}.0::DOUBLE + "
                     f"(({x} - {lo}.0::DOUBLE) / {hi - lo}.0::DOUBLE) * {ihi - ilo}.0::DOUBLE")
    parts.append(f"WHEN {x} > {table[-1][1]} THEN 500.0::DOUBLE")
    return "CASE " + " ".join(parts) + " ELSE NULL END"


def _aqi_sql(x: str = "{}") -> str:
    return "greatest(" + ", ".join(_si_sql(x.format(k), t) for k, t in _SEGMENTS.items()) + ")"


_DATE_SQL = ("CAST(coalesce(" + ", ".join(
    f"try_strptime({_nt('date')}, '{f}')" for f in ("%Y-%m-%d", "%d-%m-%Y", "%m/%d/%Y", "%Y/%m/%d"))
    + ") AS DATE)")

CTE_L = f"""L AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
         'S' || CAST(l_suppkey AS VARCHAR) AS location,
         {_tok_sql(0, 'l_quantity')} AS so2,
         {_tok_sql(1, _half('l_discount * 1000'))} AS no2,
         {_tok_sql(2, _half('l_extendedprice / 200'))} AS rspm,
         {_tok_sql(3, _half('l_extendedprice / 100'))} AS spm,
         CASE WHEN l_orderkey % 3 = 0 THEN 'NA'
              ELSE CAST({_half('(l_tax * 4000 + l_linenumber * 1.5)')} AS VARCHAR) END AS pm2_5,
         CASE WHEN l_orderkey % 97 = 0 THEN 'NA'
              WHEN l_orderkey % 4 = 0 THEN strftime(l_shipdate, '%Y-%m-%d')
              WHEN l_orderkey % 4 = 1 THEN strftime(l_shipdate, '%d-%m-%Y')
              WHEN l_orderkey % 4 = 2 THEN strftime(l_shipdate, '%m/%d/%Y')
              ELSE strftime(l_shipdate, '%Y/%m/%d') END AS date
  FROM lineitem)"""

CTE_C = f"""C AS (
  SELECT l_orderkey, l_linenumber, l_partkey, location AS city,
         TRY_CAST({_nt('so2')} AS DOUBLE) AS so2, TRY_CAST({_nt('no2')} AS DOUBLE) AS no2,
         TRY_CAST({_nt('rspm')} AS DOUBLE) AS pm10, TRY_CAST({_nt('pm2_5')} AS DOUBLE) AS pm2_5,
         TRY_CAST({_nt('spm')} AS DOUBLE) AS spm, {_DATE_SQL} AS date_parsed
  FROM L),
C2 AS (
  SELECT *, CAST(year(date_parsed) AS INTEGER) AS year, CAST(month(date_parsed) AS INTEGER) AS month,
         CAST(day(date_parsed) AS INTEGER) AS day FROM C),
D AS (SELECT * FROM C2 WHERE date_parsed IS NOT NULL)"""

CTE_I = """M AS (
  SELECT quantile_disc(so2, 0.5) AS m_so2, quantile_disc(no2, 0.5) AS m_no2,
         quantile_disc(pm10, 0.5) AS m_pm10, quantile_disc(pm2_5, 0.5) AS m_pm2_5 FROM C),
I AS (
  SELECT C2.* REPLACE (coalesce(so2, m_so2) AS so2, coalesce(no2, m_no2) AS no2,
                       coalesce(pm10, m_pm10) AS pm10, coalesce(pm2_5, m_pm2_5) AS pm2_5)
  FROM C2 CROSS JOIN M)"""

CTE_A = f"""A AS (SELECT *, {_aqi_sql()} AS AQI FROM I),
A0 AS (SELECT *, {_aqi_sql()} AS AQI FROM C2)"""

CTE_B = """B AS (
  SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper
  FROM (SELECT quantile_disc(AQI, 0.25) AS q1, quantile_disc(AQI, 0.75) AS q3 FROM A WHERE AQI IS NOT NULL))"""

_READ_ORDER = "PARTITION BY city ORDER BY date_parsed, l_orderkey, l_linenumber, l_partkey"
_EV_ORDER = "PARTITION BY user_id ORDER BY ts, event_id"

CTE_P = f"""P AS (SELECT * FROM A WHERE AQI IS NOT NULL AND date_parsed IS NOT NULL),
PT AS (SELECT * FROM (SELECT *, lead(AQI, 1) OVER ({_READ_ORDER}) AS AQI_target FROM P)
       WHERE AQI_target IS NOT NULL)"""

CTE_F = f"""PI AS (SELECT A.* FROM A, B WHERE A.AQI >= B.lower AND A.AQI <= B.upper AND A.date_parsed IS NOT NULL),
F0 AS (
  SELECT *, lead(AQI, 1) OVER w AS AQI_target, lag(AQI, 1) OVER w AS AQI_lag1,
         lag(AQI, 24) OVER w AS AQI_lag24,
         avg(AQI) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS AQI_rolling_24,
         sin(2 * pi() * month / 12.0) AS month_sin, cos(2 * pi() * month / 12.0) AS month_cos,
         pm2_5 * so2 AS pm25_x_so2, no2 * pm10 AS no2_x_pm10
  FROM PI WINDOW w AS ({_READ_ORDER})),
FT AS (SELECT * FROM F0 WHERE {' AND '.join(f'{c} IS NOT NULL AND NOT isnan({c})' for c in (*_INPUTS, _LABEL))})"""

CTE_T = f"""ET AS (SELECT * FROM (SELECT *, lead(value, 1) OVER ({_EV_ORDER}) AS value_target FROM events)
       WHERE value_target IS NOT NULL)"""


CTE_PERIODS = """T AS (SELECT * FROM A WHERE AQI IS NOT NULL),
S AS (SELECT 'all' AS period, * FROM T UNION ALL SELECT 'to 1997', * FROM T WHERE date_parsed <= DATE '1997-12-31'
      UNION ALL SELECT '1997 and 1998', * FROM T WHERE date_parsed BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'),
V AS (""" + " UNION ALL ".join(f"""SELECT period, '{c}' AS "column", {c} AS x FROM S""" for c in (*POLLUTANTS, "AQI")) + ")"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _r(c: str, alias: str | None = None) -> str:
    # "+ 0.0" turns DuckDB's rounded -0.0 into 0.0, as Spark's round gives
    return f"round({c}, 6) + 0.0 AS {alias or c}"


_METRICS_SQL = """round(sqrt(avg((value_target - value) * (value_target - value))), 6) AS RMSE,
       round(avg(abs(value_target - value)), 6) AS MAE,
       round(coalesce(avg(CASE WHEN value_target <> 0 THEN abs(value_target - value) / abs(value_target) END) * 100.0, 'NaN'::DOUBLE), 6) AS MAPE,
       round(CASE WHEN var_pop(value_target) * count(*) = 0 THEN 0.0
                  ELSE 1.0 - sum((value_target - value) * (value_target - value)) / (var_pop(value_target) * count(*)) END, 6) AS R2,
       count(*) AS n"""

_SPLIT_SQL = """SELECT split, CAST(count(*) AS BIGINT) AS rows,
       round(count(*) / sum(count(*)) OVER (), 6) AS share,
       min(date_parsed) AS first_date, max(date_parsed) AS last_date
FROM S WHERE split IS NOT NULL GROUP BY split"""

_YEARS_SQL = """Y AS (SELECT year, CAST(count(*) AS BIGINT) AS rows FROM D GROUP BY year),
YS AS (
  SELECT year, rows, CAST(sum(rows) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_rows,
         sum(rows) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(rows) OVER () AS cum_share,
         CAST(row_number() OVER (ORDER BY year) - 1 AS BIGINT) AS year_idx,
         CAST(count(*) OVER () AS BIGINT) AS n_years
  FROM Y)"""

_F = ", ".join(c if c in ("month", "day") else _r(c) for c in (*_INPUTS, _LABEL))

_ORACLE: dict[str, str] = {
    "clean_tokens_cast": _with(CTE_L, CTE_C) + "SELECT l_orderkey, l_linenumber, l_partkey, city, so2, no2, pm10, pm2_5, spm FROM C",
    "parse_dates": _with(CTE_L, CTE_C) + "SELECT l_orderkey, l_linenumber, l_partkey, date_parsed, year, month, day FROM D",
    "load_profile": "SELECT count(*) AS rows, 10 AS columns FROM lineitem",
    "median_values": _with(CTE_L, CTE_C, CTE_I) + "SELECT m_so2 AS so2, m_no2 AS no2, m_pm10 AS pm10, m_pm2_5 AS pm2_5 FROM M",
    "impute_median": _with(CTE_L, CTE_C, CTE_I) + "SELECT l_orderkey, l_linenumber, l_partkey, so2, no2, pm10, pm2_5 FROM I",
    "sub_index_each": _with(CTE_L, CTE_C) + "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(
        f"round({_si_sql(k, t)}, 6) AS si_{k}" for k, t in _SEGMENTS.items()) + " FROM C2",
    "aqi": _with(CTE_L, CTE_C, CTE_I, CTE_A) + "SELECT l_orderkey, l_linenumber, l_partkey, round(AQI, 6) AS AQI FROM A",
    "drop_missing_aqi": _with(CTE_L, CTE_C, CTE_I, CTE_A) + "SELECT l_orderkey, l_linenumber, l_partkey, round(AQI, 6) AS AQI FROM A0 WHERE AQI IS NOT NULL",
    "iqr_bounds": _with(CTE_L, CTE_C, CTE_I, CTE_A, CTE_B) + "SELECT " + ", ".join(_r(c) for c in ("q1", "q3", "iqr", "lower", "upper")) + " FROM B",
    "iqr_bounds_by_entity": _with(CTE_L, CTE_C, CTE_I, CTE_A) + """
SELECT city, """ + ", ".join(_r(c) for c in ("q1", "q3", "iqr", "lower", "upper")) + """ FROM (
  SELECT city, q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper
  FROM (SELECT city, quantile_disc(AQI, 0.25) AS q1, quantile_disc(AQI, 0.75) AS q3
        FROM A WHERE AQI IS NOT NULL GROUP BY city))""",
    "iqr_filter": _with(CTE_L, CTE_C, CTE_I, CTE_A, CTE_B) + "SELECT l_orderkey, l_linenumber, l_partkey, round(AQI, 6) AS AQI FROM A, B WHERE AQI IS NOT NULL AND AQI >= lower AND AQI <= upper",
    "row_drop_audit": _with(CTE_L, CTE_C, CTE_I, CTE_A, CTE_B) + """,
K AS (SELECT count(*) AS s0,
             count(*) FILTER (WHERE AQI IS NOT NULL) AS s1,
             count(*) FILTER (WHERE AQI IS NOT NULL AND AQI >= lower AND AQI <= upper) AS s2,
             count(*) FILTER (WHERE AQI IS NOT NULL AND AQI >= lower AND AQI <= upper AND date_parsed IS NOT NULL) AS s3
      FROM A, B)
SELECT * , rows_before - rows_after AS dropped FROM (
  SELECT 1 AS step_no, 'aqi_not_null' AS step, s0 AS rows_before, s1 AS rows_after FROM K UNION ALL
  SELECT 2, 'iqr_within', s1, s2 FROM K UNION ALL
  SELECT 3, 'date_parsed', s2, s3 FROM K)""",
    "forecast_target_events": _with(CTE_T) + "SELECT user_id, ts, event_id, value, value_target FROM ET",
    "forecast_target_readings": _with(CTE_L, CTE_C, CTE_I, CTE_A, CTE_P) + "SELECT l_orderkey, l_linenumber, l_partkey, city, date_parsed, round(AQI, 6) AS AQI, round(AQI_target, 6) AS AQI_target FROM PT",
    "lag_features": f"SELECT user_id, ts, event_id, lag(value, 1) OVER w AS value_lag1, lag(value, 24) OVER w AS value_lag24 FROM events WINDOW w AS ({_EV_ORDER})",
    "rolling_mean": f"SELECT user_id, ts, event_id, round(avg(value) OVER ({_EV_ORDER} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS value_rolling_24 FROM events",
    "cyclic_encoding": _with(CTE_L, CTE_C) + "SELECT l_orderkey, l_linenumber, l_partkey, month, round(sin(2 * pi() * month / 12.0), 6) + 0.0 AS month_sin, round(cos(2 * pi() * month / 12.0), 6) + 0.0 AS month_cos FROM D",
    "interactions": _with(CTE_L, CTE_C, CTE_I) + "SELECT l_orderkey, l_linenumber, l_partkey, round(pm2_5 * so2, 6) AS pm25_x_so2, round(no2 * pm10, 6) AS no2_x_pm10 FROM I",
    "feature_table": _with(CTE_L, CTE_C, CTE_I, CTE_A, CTE_B, CTE_F) + f"SELECT l_orderkey, l_linenumber, l_partkey, city, date_parsed, {_F} FROM FT",
    "feature_table_chunked": _with(CTE_L, CTE_C, CTE_I, CTE_A, CTE_B, CTE_F) + f"SELECT l_orderkey, l_linenumber, l_partkey, city, date_parsed, {_F} FROM FT",
    "panel_features_chunked": f"""SELECT * FROM (
  SELECT user_id, ts, event_id, lead(value, 1) OVER w AS value_target, lag(value, 1) OVER w AS value_lag1,
         lag(value, 24) OVER w AS value_lag24,
         round(avg(value) OVER ({_EV_ORDER} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS value_rolling_24
  FROM events WINDOW w AS ({_EV_ORDER})) WHERE value_target IS NOT NULL""",
    "year_counts": _with(CTE_L, CTE_C) + "SELECT year, CAST(count(*) AS BIGINT) AS rows FROM D GROUP BY year",
    "cumulative_share": _with(CTE_L, CTE_C, _YEARS_SQL) + "SELECT year, rows, cum_rows, round(cum_share, 6) AS cum_share, year_idx, n_years FROM YS",
    "chrono_split_years": _with(CTE_L, CTE_C, _YEARS_SQL) + """,
H AS (SELECT n_years, least(coalesce(min(CASE WHEN cum_share >= 0.8 THEN year_idx END), n_years - 2), n_years - 2 - 1) AS split_idx
      FROM YS GROUP BY n_years),
YB AS (SELECT max(year) AS last_train_year FROM YS, H WHERE year_idx = split_idx),
S AS (SELECT D.*, CASE WHEN year <= last_train_year THEN 'train' ELSE 'test' END AS split FROM D, YB)
""" + _SPLIT_SQL,
    "chrono_split_date": """WITH E AS (SELECT *, CAST(ts AS DATE) AS date_parsed FROM events),
Q AS (SELECT quantile_disc(date_parsed, 0.8) AS split_date FROM E),
S AS (SELECT E.*, CASE WHEN date_parsed <= split_date THEN 'train' ELSE 'test' END AS split FROM E, Q)
""" + _SPLIT_SQL,
    "calendar_target": _with(CTE_L, CTE_C, CTE_I, CTE_A, CTE_P) + """,
DY AS (SELECT city, date_parsed, avg(AQI) AS AQI, count(*) AS readings FROM P GROUP BY city, date_parsed),
DL AS (SELECT *, lead(AQI) OVER w AS v1, lead(date_parsed) OVER w AS d1 FROM DY
       WINDOW w AS (PARTITION BY city ORDER BY date_parsed))
SELECT city, date_parsed, round(AQI, 6) AS AQI, readings, round(v1, 6) AS AQI_target_1d
FROM DL WHERE date_diff('day', date_parsed, d1) = 1""",
    "entity_date_split": """WITH E AS (SELECT *, CAST(ts AS DATE) AS date_parsed FROM events),
Q AS (SELECT user_id, quantile_disc(date_parsed, 0.8) AS cut FROM E GROUP BY user_id)
SELECT user_id, CASE WHEN date_parsed <= cut THEN 'train' ELSE 'test' END AS split, count(*) AS rows
FROM E JOIN Q USING (user_id) GROUP BY 1, 2""",
    "top_entities": _with(CTE_L, CTE_C) + "SELECT city, CAST(count(*) AS BIGINT) AS rows FROM D WHERE city IS NOT NULL GROUP BY city ORDER BY rows DESC, city LIMIT 3",
    "leave_one_out_counts": _with(CTE_L, CTE_C) + """,
T AS (SELECT city, count(*) AS rows FROM D WHERE city IS NOT NULL GROUP BY city ORDER BY rows DESC, city LIMIT 3)
SELECT city, CAST((SELECT count(city) FROM D) - rows AS BIGINT) AS train_rows, CAST(rows AS BIGINT) AS test_rows FROM T""",
    "label_stats": _with(CTE_L, CTE_C, CTE_I, CTE_A, CTE_P) + "SELECT round(avg(AQI_target), 6) AS mean, round(stddev_samp(AQI_target), 6) AS std, round(min(AQI_target), 6) AS min, round(max(AQI_target), 6) AS max, count(AQI_target) AS n FROM PT",
    "regression_metrics": _with(CTE_T) + "SELECT " + _METRICS_SQL + " FROM ET",
    "regression_metrics_by_entity": _with(CTE_T) + "SELECT user_id, " + _METRICS_SQL + " FROM ET GROUP BY user_id",
    "scaled_features": _with(CTE_L, CTE_C, CTE_I, CTE_A, CTE_B, CTE_F) + "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(
        f"round(CASE WHEN stddev_samp({c}) OVER () = 0 THEN 0.0 ELSE ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () END, 6) + 0.0 AS z_{c}"
        for c in _INPUTS) + " FROM FT",
    "label_scaling": _with(CTE_L, CTE_C, CTE_I, CTE_A, CTE_P) + """,
PM AS MATERIALIZED (SELECT l_orderkey, l_linenumber, l_partkey, AQI_target FROM PT),
Z AS MATERIALIZED (SELECT avg(AQI_target) AS m, stddev_pop(AQI_target) AS s FROM PM)
SELECT l_orderkey, l_linenumber, l_partkey, round((AQI_target - m) / s, 6) + 0.0 AS y_scaled,
       round(((AQI_target - m) / s) * s + m, 6) AS y_restored FROM PM CROSS JOIN Z""",
    "sequence_windows": f"""SELECT user_id, ts, event_id, seq_len, seq_first, seq_last, round(seq_sum, 6) AS seq_sum FROM (
  SELECT user_id, ts, event_id,
         CAST(count(value) OVER f AS INTEGER) AS seq_len, first_value(value) OVER f AS seq_first,
         last_value(value) OVER f AS seq_last, sum(value) OVER f AS seq_sum
  FROM events WINDOW f AS ({_EV_ORDER} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
WHERE seq_len = 24""",
    "positional_split": f"""SELECT user_id, ts, event_id,
  CASE WHEN row_number() OVER ({_EV_ORDER}) - 1 < floor(0.8 * count(*) OVER (PARTITION BY user_id)) THEN 'train' ELSE 'test' END AS split
FROM events""",
    "ols_one_feature": _with(CTE_L, CTE_C, CTE_I, CTE_A, CTE_P) + "SELECT round(regr_slope(AQI_target, AQI), 6) AS slope, round(regr_intercept(AQI_target, AQI), 6) AS intercept FROM PT",
    "stage_dataset": _with(CTE_L, CTE_C) + "SELECT year, CAST(count(*) AS BIGINT) AS rows FROM C2 GROUP BY year",
}


def _leak_free_sql() -> str:
    """Split on dated rows; medians and outlier bounds of the training years; windows over all readings."""
    features = ", ".join(c if c in ("month", "day") else _r(c) for c in (*_INPUTS, _LABEL))
    order = _READ_ORDER
    return _with(CTE_L, CTE_C, _YEARS_SQL) + f""",
H AS (SELECT n_years, least(coalesce(min(CASE WHEN cum_share >= 0.8 THEN year_idx END), n_years - 2), n_years - 2 - 1) AS split_idx
      FROM YS GROUP BY n_years),
YB AS (SELECT max(year) AS last_year FROM YS, H WHERE year_idx = split_idx),
S AS (SELECT D.*, CASE WHEN year <= last_year THEN 'train' ELSE 'test' END AS split FROM D, YB),
M AS (SELECT quantile_disc(so2, 0.5) AS m_so2, quantile_disc(no2, 0.5) AS m_no2, quantile_disc(pm10, 0.5) AS m_pm10,
             quantile_disc(pm2_5, 0.5) AS m_pm2_5 FROM S WHERE split = 'train'),
I AS (SELECT S.* REPLACE (coalesce(so2, m_so2) AS so2, coalesce(no2, m_no2) AS no2, coalesce(pm10, m_pm10) AS pm10,
                          coalesce(pm2_5, m_pm2_5) AS pm2_5) FROM S CROSS JOIN M),
A AS (SELECT * FROM (SELECT *, {_aqi_sql()} AS AQI FROM I) WHERE AQI IS NOT NULL),
Q AS (SELECT quantile_disc(AQI, 0.25) AS q1, quantile_disc(AQI, 0.75) AS q3 FROM A WHERE split = 'train'),
G AS (SELECT A.*, NOT (AQI >= q1 - 1.5 * (q3 - q1) AND AQI <= q3 + 1.5 * (q3 - q1)) AS is_outlier FROM A, Q),
W AS (SELECT *, lead(AQI, 1) OVER w AS AQI_target, lead(year, 1) OVER w AS target_year, lag(AQI, 1) OVER w AS AQI_lag1,
         lag(AQI, 24) OVER w AS AQI_lag24, avg(AQI) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS AQI_rolling_24,
         sin(2 * pi() * month / 12.0) AS month_sin, cos(2 * pi() * month / 12.0) AS month_cos,
         pm2_5 * so2 AS pm25_x_so2, no2 * pm10 AS no2_x_pm10
      FROM G WINDOW w AS ({order}))
SELECT l_orderkey, l_linenumber, l_partkey, city, date_parsed, split, is_outlier, {features} FROM W, YB
WHERE AQI_target IS NOT NULL AND AQI_lag24 IS NOT NULL AND NOT (split = 'train' AND target_year > last_year)
  AND NOT (split = 'train' AND is_outlier)"""


def _stump_sql() -> str:
    return _with(CTE_L, CTE_C, CTE_I, CTE_A, CTE_P) + """,
MS AS (SELECT month, count(*) AS n, sum(AQI_target) AS s FROM PT GROUP BY month),
CUT AS (SELECT a.month AS cut, sum(CASE WHEN b.month <= a.month THEN b.n END) AS nl, sum(CASE WHEN b.month <= a.month THEN b.s END) AS sl,
               sum(CASE WHEN b.month > a.month THEN b.n END) AS nr, sum(CASE WHEN b.month > a.month THEN b.s END) AS sr
        FROM MS a, MS b GROUP BY a.month),
BEST AS (SELECT * FROM CUT WHERE nr IS NOT NULL ORDER BY sl * sl / nl + sr * sr / nr DESC, cut LIMIT 1)
SELECT month, round(CASE WHEN month <= cut THEN sl / nl ELSE sr / nr END, 6) AS prediction FROM MS, BEST"""


def _cross_entity_sql() -> str:
    """The three folds in one statement: every statistic is grouped by the entity held out."""
    return _with(CTE_L, CTE_C) + f""",
T AS (SELECT city AS held FROM (SELECT city, count(*) AS rows FROM D WHERE city IS NOT NULL GROUP BY city ORDER BY rows DESC, city LIMIT 3)),
X AS (SELECT D.*, held FROM D, T WHERE city IS NOT NULL),
M AS (SELECT held, quantile_disc(so2, 0.5) AS m_so2, quantile_disc(no2, 0.5) AS m_no2, quantile_disc(pm10, 0.5) AS m_pm10,
             quantile_disc(pm2_5, 0.5) AS m_pm2_5 FROM X WHERE city <> held GROUP BY held),
I AS (SELECT X.* REPLACE (coalesce(so2, m_so2) AS so2, coalesce(no2, m_no2) AS no2, coalesce(pm10, m_pm10) AS pm10,
                          coalesce(pm2_5, m_pm2_5) AS pm2_5) FROM X JOIN M USING (held)),
A AS (SELECT * FROM (SELECT *, {_aqi_sql()} AS AQI FROM I) WHERE AQI IS NOT NULL),
Q AS (SELECT held, quantile_disc(AQI, 0.25) AS q1, quantile_disc(AQI, 0.75) AS q3 FROM A WHERE city <> held GROUP BY held),
W AS (SELECT *, lead(AQI, 1) OVER w AS y, lag(AQI, 1) OVER w AS x, lag(AQI, 24) OVER w AS x24
      FROM A WINDOW w AS (PARTITION BY held, city ORDER BY date_parsed, l_orderkey, l_linenumber, l_partkey)),
V AS (SELECT * FROM W WHERE y IS NOT NULL AND x24 IS NOT NULL),
R AS (SELECT V.held, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM V JOIN Q USING (held)
      WHERE city <> held AND AQI >= q1 - 1.5 * (q3 - q1) AND AQI <= q3 + 1.5 * (q3 - q1) GROUP BY V.held)
SELECT city, round(sqrt(avg((y - a - b * x) * (y - a - b * x))), 6) AS RMSE, round(avg(abs(y - a - b * x)), 6) AS MAE, count(*) AS n
FROM V JOIN R USING (held) WHERE city = held GROUP BY city"""


def _evaluate_sql() -> str:
    stump = _stump_sql().replace("SELECT month, round(CASE WHEN month <= cut THEN sl / nl ELSE sr / nr END, 6) AS prediction FROM MS, BEST", "")
    return stump + """,
LR AS (SELECT regr_slope(AQI_target, month) AS b, regr_intercept(AQI_target, month) AS a FROM PT),
TP AS (SELECT AQI_target AS y, CASE WHEN month <= cut THEN sl / nl ELSE sr / nr END AS p FROM PT, BEST),
SC AS (SELECT 'LinearRegression' AS model, AQI_target AS y, a + b * month AS p FROM PT, LR
       UNION ALL SELECT 'RandomForest', y, p FROM TP UNION ALL SELECT 'GBTRegressor', y, p FROM TP)
SELECT model, round(sqrt(avg((y - p) * (y - p))), 6) AS RMSE, round(avg(abs(y - p)), 6) AS MAE,
       round(avg(CASE WHEN y <> 0 THEN abs(y - p) / abs(y) END) * 100.0, 6) AS MAPE,
       round(1.0 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) + 0.0 AS R2, count(*) AS n
FROM SC GROUP BY model"""


def _importance_sql() -> str:
    gains = " UNION ALL ".join(f"""SELECT '{c}' AS feature, max(sl * sl / nl + sr * sr / nr) AS gain FROM (
  SELECT a.v, sum(CASE WHEN b.v <= a.v THEN b.n END) AS nl, sum(CASE WHEN b.v <= a.v THEN b.s END) AS sl,
         sum(CASE WHEN b.v > a.v THEN b.n END) AS nr, sum(CASE WHEN b.v > a.v THEN b.s END) AS sr
  FROM (SELECT {c} AS v, count(*) AS n, sum(AQI_target) AS s FROM PT GROUP BY 1) a, (SELECT {c} AS v, count(*) AS n, sum(AQI_target) AS s FROM PT GROUP BY 1) b
  GROUP BY a.v) WHERE nr IS NOT NULL""" for c in ("month", "day"))
    return _with(CTE_L, CTE_C, CTE_I, CTE_A, CTE_P) + f""",
G AS ({gains})
SELECT CAST(row_number() OVER (ORDER BY gain DESC) AS INTEGER) AS rank, feature, CASE WHEN gain = max(gain) OVER () THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS importance FROM G"""


_HOT = "CASE WHEN {k} % 3 <> 0 THEN 'hot' WHEN {k} % 6 = 0 THEN 'cold' END"
_B5 = ", ".join(_r(c) for c in ("q1", "q3", "iqr", "lower", "upper"))
_PERSIST = _METRICS_SQL.replace("* 100.0, 'NaN'::DOUBLE), 6)", "* 100.0, 'NaN'::DOUBLE), 2)")
def _calendar_sql(entity: str) -> str:
    return f"""WITH E AS (SELECT event_id, value, {entity} AS part, CAST(ts AS DATE) AS dd FROM events),
DY AS (SELECT part, dd, avg(value) AS v FROM E GROUP BY part, dd)
SELECT E.event_id, round(a.v, 9) AS value_lag1d, round(b.v, 9) AS value_lag24d,
       round(avg(value) OVER (PARTITION BY E.part ORDER BY E.dd RANGE BETWEEN INTERVAL 23 DAYS PRECEDING AND CURRENT ROW), 9) AS value_rolling_24d
FROM E LEFT JOIN DY a ON a.part IS NOT DISTINCT FROM E.part AND a.dd = E.dd - 1
LEFT JOIN DY b ON b.part IS NOT DISTINCT FROM E.part AND b.dd = E.dd - 24"""


def _asof_sql(key: str) -> str:
    return f"""WITH E AS (SELECT *, {key} AS k FROM events),
V AS (SELECT k, ts, event_id AS view_id, value AS view_value FROM E WHERE event_type = 'view')
SELECT E.event_id, V.view_id, V.view_value FROM E ASOF LEFT JOIN V ON E.k = V.k AND E.ts > V.ts"""


_SPANS = """S AS (SELECT k, event_id AS span_id, ts AS lo, ts + to_hours(CAST(CASE WHEN event_id % 11 = 0 THEN 480 ELSE 1 + event_id % 7 END AS INTEGER)) AS hi
  FROM E WHERE event_type = 'signup')"""

_JSON = """J AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 13 = 0 THEN left(t, 25) ELSE t END AS t FROM (
  SELECT *, CAST(json_object('location', location, 'date', date, 'readings', json_object('so2', so2, 'no2', no2, 'pm2_5', pm2_5)) AS VARCHAR) AS t FROM L)),
JV AS (SELECT *, NOT json_valid(t) AS bad, CASE WHEN json_valid(t) THEN t END AS ok FROM J)"""

_ORACLE.update({
    "metrics_by_levels": _with(CTE_T) + """,
ML AS (SELECT *, CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday FROM ET)
SELECT CAST(CASE grouping(user_id, weekday, event_type) WHEN 1 THEN 0 WHEN 3 THEN 1 WHEN 6 THEN 2 ELSE 3 END AS INTEGER) AS level, user_id, weekday, event_type, """
    + _METRICS_SQL + " FROM ML GROUP BY GROUPING SETS ((user_id, weekday), (user_id), (event_type), ())",
    "split_audit": _with(CTE_L, CTE_C) + """,
TA AS (SELECT city, month, so2, no2 FROM C2 WHERE l_orderkey % 2 = 0), TB AS (SELECT city, month, so2, no2 FROM C2 WHERE l_orderkey % 2 <> 0)
SELECT (SELECT count(*) FROM TA) AS train_rows, (SELECT count(*) FROM TB) AS test_rows,
       (SELECT count(*) FROM (SELECT * FROM TA INTERSECT ALL SELECT * FROM TB)) AS shared,
       (SELECT count(*) FROM (SELECT * FROM TA EXCEPT ALL SELECT * FROM TB)) AS train_only,
       (SELECT count(*) FROM (SELECT * FROM TB EXCEPT ALL SELECT * FROM TA)) AS test_only""",
    "sql_functions": _with(CTE_L, CTE_C, CTE_I, CTE_A) + """SELECT l_orderkey, l_linenumber, l_partkey, round(AQI, 6) AS AQI,
  CASE WHEN l_orderkey % 10 <= 7 THEN 'train' ELSE 'test' END AS part FROM A0""",
    "sql_breakpoints": _with(CTE_L, CTE_C) + ", B AS (SELECT * FROM (VALUES " + ", ".join(f"({a}.0::DOUBLE, {b}.0::DOUBLE)" for a, b, _, _ in _SEGMENTS["pm10"])
    + ") t(low, high)) SELECT low, high, count(pm10) AS readings FROM B LEFT JOIN C ON pm10 >= low AND pm10 <= high GROUP BY low, high",
    "json_readings": _with(CTE_L, _JSON) + """SELECT l_orderkey, l_linenumber, l_partkey, bad, json_extract_string(ok, '$.location') AS location, json_extract_string(ok, '$.date') AS date,
  json_extract_string(ok, '$.readings.so2') AS so2, json_extract_string(ok, '$.readings.no2') AS no2, json_extract_string(ok, '$.readings.pm2_5') AS pm2_5 FROM JV""",
    "json_document_counts": _with(CTE_L, _JSON) + "SELECT count(*) AS documents, count(*) FILTER (WHERE bad) AS bad FROM JV",
    "period_moments": _with(CTE_L, CTE_C, CTE_I, CTE_A, CTE_PERIODS) + """SELECT period, "column", count(x) AS n, count(*) - count(x) AS missing,
  round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max FROM V GROUP BY 1, 2""",
    # cells of the states: 1 % either side; all values are positive or zero
    "period_quantiles": _with(CTE_L, CTE_C, CTE_I, CTE_A, CTE_PERIODS) + """,
K AS (SELECT period, "column", CASE WHEN x = 0 THEN 0 ELSE ceil(ln(x) / ln(1.01::DOUBLE / 0.99::DOUBLE)) + 268435456 END AS cell, count(*) AS n, min(x) AS low, max(x) AS high
      FROM V WHERE x IS NOT NULL GROUP BY 1, 2, 3),
U AS (SELECT *, sum(n) OVER (PARTITION BY period, "column") AS total, sum(n) OVER (PARTITION BY period, "column" ORDER BY low) AS upto FROM K),
R AS (SELECT *, CAST(greatest(ceil(prob * total), 1) AS BIGINT) AS rank FROM U CROSS JOIN (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) p(prob))
SELECT period, "column", prob, round(CASE WHEN low = high THEN low ELSE low * 2 / (1 + low / high) END, 6) AS value, round(low, 6) AS low, round(high, 6) AS high,
  rank, CAST(upto - n AS BIGINT) AS below FROM R WHERE upto >= rank AND upto - n < rank""",
    "period_fits": _with(CTE_L, CTE_C, CTE_I, CTE_A, CTE_PERIODS) + """, Q AS (SELECT period, "column", quantile_disc(x, [0.25, 0.5, 0.75]) AS q FROM V WHERE x IS NOT NULL GROUP BY 1, 2)
SELECT period, """ + ", ".join(f"""max(q[2]) FILTER ("column" = '{c}') AS {c}""" for c in POLLUTANTS) + """,
  round(max(q[1] - 1.5 * (q[3] - q[1])) FILTER ("column" = 'AQI'), 6) AS lower, round(max(q[3] + 1.5 * (q[3] - q[1])) FILTER ("column" = 'AQI'), 6) AS upper
FROM Q GROUP BY period""",
    "evaluate_one_column": _evaluate_sql(),
    "importance_ranked": _importance_sql(),
    # soft threshold of the correlation of standardised values: penalties 0.1 (0.8 of it on the absolute value), in units of the label's deviation
    "elastic_net_one_feature": _with(CTE_L, CTE_C, CTE_I, CTE_A, CTE_P) + """,
K AS (SELECT corr(AQI, AQI_target) AS r, stddev_samp(AQI_target) AS sy, avg(AQI_target) AS my, (count(*) - 1.0) / count(*) AS f FROM PT),
W AS (SELECT sign(r) * greatest(abs(r) * f - 0.08 / sy, 0) / (f + 0.02 / sy) * sy AS b, my FROM K)
SELECT round(b, 4) + 0.0 AS coefficient, round(my, 4) AS intercept FROM W""",
    "asof_join": _asof_sql("user_id"),
    "asof_join_hot": _asof_sql(_HOT.format(k="event_id")),
    "asof_join_forward": """WITH P AS (SELECT user_id, ts, event_id AS purchase_id FROM events WHERE event_type = 'purchase')
SELECT E.event_id, P.purchase_id FROM events E ASOF LEFT JOIN P ON E.user_id = P.user_id AND E.ts <= P.ts""",
    "interval_join": f"""WITH E AS (SELECT *, user_id AS k FROM events), {_SPANS}
SELECT E.event_id, S.span_id FROM E JOIN S ON E.k = S.k AND E.ts >= S.lo AND E.ts < S.hi""",
    "interval_join_hot": f"""WITH E AS (SELECT *, {_HOT.format(k="event_id")} AS k FROM events), {_SPANS}
SELECT E.event_id, count(*) AS spans, CAST(sum(S.span_id) AS BIGINT) AS span_sum FROM E JOIN S ON E.k = S.k AND E.ts >= S.lo AND E.ts < S.hi GROUP BY 1""",
    "stream_panel_features": f"""SELECT * FROM (
  SELECT user_id, ts, event_id, value, lead(value, 1) OVER w AS value_target, lag(value, 1) OVER w AS value_lag1, lag(value, 24) OVER w AS value_lag24,
         round(avg(value) OVER ({_EV_ORDER} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS value_rolling_24
  FROM events WINDOW w AS ({_EV_ORDER})) WHERE value_target IS NOT NULL""",
    "calendar_features": _calendar_sql("user_id"),
    "calendar_features_hot": _calendar_sql(_HOT.format(k="event_id")),
    "metrics_roundtrip": _with(CTE_T) + f"SELECT 'Persistence' AS model, 0.0::DOUBLE AS training_time_sec, * EXCLUDE (n) FROM (SELECT {_PERSIST} FROM ET)",
    "metrics_by_entity_roundtrip": _with(CTE_T) + f"SELECT 'Persistence_' || user_id AS model, CAST(user_id AS VARCHAR) AS user_id, * EXCLUDE (n, user_id) FROM (SELECT user_id, {_PERSIST} FROM ET GROUP BY user_id)",
    "importance_roundtrip": _with(CTE_L, CTE_C) + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(count({c}) / count(*), 6) AS importance FROM C" for c in ("so2", "no2", "pm10", "pm2_5")),
    "comparison_persistence": _with(CTE_T) + "SELECT 'Persistence' AS model, round(RMSE, 4) AS RMSE, round(MAE, 4) AS MAE, round(MAPE, 2) AS MAPE, round(R2, 4) AS R2, 0.0::DOUBLE AS training_time_sec FROM (SELECT " + _METRICS_SQL.replace(", 6)", ", 12)") + " FROM ET)",
    "preview": _with(CTE_L, CTE_C) + "SELECT l_orderkey, l_linenumber, l_partkey, city, date_parsed FROM D ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 5",
    "select_existing": _with(CTE_L, CTE_C) + "SELECT l_orderkey, l_linenumber, l_partkey, spm, city FROM C",
    # an empty field of a CSV file is a null
    "csv_scan": _with(CTE_L) + "SELECT location, nullif(so2, '') AS so2, nullif(no2, '') AS no2, nullif(rspm, '') AS rspm, nullif(spm, '') AS spm, pm2_5, date FROM L",
    "csv_folder": _with(CTE_L) + """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS stn_code, location, nullif(so2, '') AS so2, nullif(no2, '') AS no2,
  nullif(rspm, '') AS rspm, CASE WHEN l_orderkey % 3 <> 2 THEN nullif(spm, '') END AS spm, pm2_5, date FROM L""",
    "aqi_gap_round": _with(CTE_L, CTE_C, CTE_I) + f"SELECT l_orderkey, l_linenumber, l_partkey, round({_aqi_sql('round({})')}, 6) AS AQI FROM I",
    "iqr_filter_by_entity": _with(CTE_L, CTE_C, CTE_I, CTE_A) + """,
Q AS (SELECT city, quantile_disc(AQI, 0.25) AS q1, quantile_disc(AQI, 0.75) AS q3 FROM A WHERE AQI IS NOT NULL GROUP BY city)
SELECT l_orderkey, l_linenumber, l_partkey, round(AQI, 6) AS AQI FROM A JOIN Q ON A.city IS NOT DISTINCT FROM Q.city
WHERE AQI >= q1 - 1.5 * (q3 - q1) AND AQI <= q3 + 1.5 * (q3 - q1)""",
    "iqr_bounds_hot_entity": _with(CTE_L, CTE_C, CTE_I, CTE_A) + f"""
SELECT part, {_B5} FROM (SELECT part, q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper
  FROM (SELECT {_HOT.format(k='l_orderkey')} AS part, quantile_disc(AQI, 0.25) AS q1, quantile_disc(AQI, 0.75) AS q3
        FROM A WHERE AQI IS NOT NULL GROUP BY 1))""",
    "entity_date_split_hot": f"""WITH E AS (SELECT {_HOT.format(k='event_id')} AS part, CAST(ts AS DATE) AS dd FROM events),
Q AS (SELECT part, quantile_disc(dd, 0.8) AS cut FROM E WHERE part IS NOT NULL GROUP BY part)
SELECT E.part, CASE WHEN cut IS NULL THEN NULL WHEN dd <= cut THEN 'train' ELSE 'test' END AS split, count(*) AS rows
FROM E LEFT JOIN Q ON E.part = Q.part GROUP BY 1, 2""",
    "sequence_windows_offset": f"""SELECT user_id, ts, event_id, seq_first, seq_last, round(seq_sum, 6) AS seq_sum FROM (
  SELECT user_id, ts, event_id, count(value) OVER f AS c, first_value(value) OVER f AS seq_first, value AS seq_last, sum(value) OVER f AS seq_sum
  FROM events WINDOW f AS ({_EV_ORDER} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) WHERE c = 24""",
    "chunked_one_day": """SELECT * FROM (SELECT event_id, lead(value, 1) OVER w AS value_target, lag(value, 1) OVER w AS value_lag1, lag(value, 24) OVER w AS value_lag24,
  round(avg(value) OVER (ORDER BY event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS value_rolling_24
  FROM events WINDOW w AS (ORDER BY event_id)) WHERE value_target IS NOT NULL""",
    "preprocessed_table": _with(CTE_L, CTE_C, CTE_I, CTE_A, CTE_B) + "SELECT l_orderkey, l_linenumber, l_partkey, city, date_parsed, year, month, day, so2, no2, pm10, pm2_5, round(AQI, 6) AS AQI FROM A, B WHERE AQI >= lower AND AQI <= upper AND date_parsed IS NOT NULL",
    "leak_free_features": _leak_free_sql(),
    "assembled_features": _with(CTE_L, CTE_C, CTE_I, CTE_A, CTE_B, CTE_F) + "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(
        f"round({c}::DOUBLE, 6) + 0.0 AS x_{c}" for c in _INPUTS) + " FROM FT",
    "forest_one_split": _stump_sql(),
    "gbt_one_split": _stump_sql(),
    "ols_two_features": _with(CTE_L, CTE_C, CTE_I, CTE_A, CTE_P) + """,
K AS (SELECT covar_pop(AQI_target, month) AS s1y, covar_pop(AQI_target, day) AS s2y, var_pop(month) AS s11, var_pop(day) AS s22,
             covar_pop(month, day) AS s12, avg(AQI_target) AS my, avg(month) AS m1, avg(day) AS m2 FROM PT),
B2 AS (SELECT (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2, my, m1, m2 FROM K)
SELECT 'month' AS feature, round(b1, 6) + 0.0 AS coefficient FROM B2 UNION ALL SELECT 'day', round(b2, 6) + 0.0 FROM B2
UNION ALL SELECT 'intercept', round(my - b1 * m1 - b2 * m2, 6) + 0.0 FROM B2""",
    "sequence_ols": _with(CTE_L, CTE_C, CTE_I, CTE_A, CTE_P) + "SELECT round(regr_slope(AQI_target, AQI), 6) + 0.0 AS slope, round(regr_intercept(AQI_target, AQI), 6) AS intercept FROM PT",
    "cross_entity_ols": _cross_entity_sql(),
})


def oracle_sql() -> dict[str, str]:
    return {**_ORACLE, **_llm()[1]}
