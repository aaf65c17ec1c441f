"""MLlib plans, end-to-end pipeline, sources/sinks and the stream."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from panelcast.operators.features import FEATURE_COLUMNS, LABEL_COL
from panelcast.plans.models import (
    feature_importance,
    fit_features,
    fit_sequence_regression,
    sequence_vectors,
    train_models,
)
from panelcast.plans.pipeline import build_feature_table, run_forecast
from panelcast.sources.adapters import READINGS_SPEC, lineitem_readings
from panelcast.sources.readings import RAW_SCHEMA, load_profile, read_readings
from panelcast.sources.sinks import metrics_frame, write_importance_csv, write_metrics_csv

from conftest import SF001

SMALL = {"RandomForest": {"numTrees": 5, "maxDepth": 4}, "GBTRegressor": {"maxIter": 3, "maxDepth": 3}}


@pytest.fixture(scope="module")
def feats(spark):
    f, boundary, medians, bounds = build_feature_table(lineitem_readings(spark, SF001), READINGS_SPEC)
    out = f.persist()
    out.count()
    return out, boundary, medians, bounds


def test_feature_table_leak_free(spark, feats):
    f, boundary, medians, bounds = feats
    assert boundary.kind == "year" and set(medians) == {"so2", "no2", "pm10", "pm2_5"}
    train = f.filter("split = 'train'")
    test = f.filter("split = 'test'")
    assert train.agg(F.max("year")).first()[0] < test.agg(F.min("year")).first()[0]
    assert train.filter("is_outlier").count() == 0  # outliers leave train only
    assert f.select([F.count(F.when(F.col(c).isNull(), 1)) for c in FEATURE_COLUMNS]).first() == tuple([0] * 13)


def test_ols_matches_sql_regression(spark, feats):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    f = feats[0]
    vec = VectorAssembler(inputCols=["AQI_lag1"], outputCol="x").transform(f)
    m = LinearRegression(featuresCol="x", labelCol=LABEL_COL, regParam=0.0, solver="normal").fit(vec)
    r = f.agg(F.regr_slope(LABEL_COL, "AQI_lag1").alias("s"), F.regr_intercept(LABEL_COL, "AQI_lag1").alias("i")).first()
    assert m.coefficients[0] == pytest.approx(r["s"], rel=1e-8)
    assert m.intercept == pytest.approx(r["i"], rel=1e-8)


def test_models_and_importance(spark, feats):
    f = feats[0]
    train = f.filter("split = 'train'")
    fz = fit_features(train)
    tv = fz.transform(train)
    models = train_models(tv, ["LinearRegression", "RandomForest", "GBTRegressor"], params=SMALL)
    assert set(models) == {"LinearRegression", "RandomForest", "GBTRegressor"}
    imp = feature_importance(spark, models["RandomForest"][0])
    vals = [r["importance"] for r in imp.collect()]
    assert sum(vals) == pytest.approx(1.0) and vals == sorted(vals, reverse=True)
    again = train_models(tv, ["RandomForest"], params=SMALL)["RandomForest"][0]
    assert again.featureImportances == models["RandomForest"][0].featureImportances  # same seed


def test_run_forecast_schema(spark):
    res = run_forecast(lineitem_readings(spark, SF001), READINGS_SPEC, params=SMALL, include_sequence=True)
    rows = res.metrics.collect()
    assert {r["model"] for r in rows} == {"LinearRegression", "RandomForest", "GBTRegressor", "SequenceLinear"}
    assert res.metrics.columns == ["model", "RMSE", "MAE", "MAPE", "R2", "training_time_sec", "n"]
    assert res.importance.count() == 13


def test_run_forecast_compat(spark):
    res = run_forecast(lineitem_readings(spark, SF001), READINGS_SPEC, compat=True,
                       models=("LinearRegression",), partitions=2)
    assert res.metrics.count() == 1 and res.boundary.kind == "year"


def test_sequence_regression(spark, feats):
    from panelcast.operators.sequences import sequence_windows
    seq = sequence_windows(feats[0], READINGS_SPEC, FEATURE_COLUMNS, LABEL_COL, 4)
    model, secs = fit_sequence_regression(seq, LABEL_COL)
    assert model.numFeatures == 4 * 13
    assert sequence_vectors(seq).select("features").first()[0].size == 52


def test_read_fallback_and_profile(spark):
    d = tempfile.mkdtemp()
    path = os.path.join(d, "readings.csv")
    with open(path, "w") as fh:
        fh.write(",".join(f.name for f in RAW_SCHEMA.fields) + "\n")
        fh.write(",".join(["x"] * 13) + "\n")
    df = read_readings(spark, [os.path.join(d, "missing.csv"), path])
    assert load_profile(df).first() == (1, 13)
    with pytest.raises(FileNotFoundError):
        read_readings(spark, [os.path.join(d, "missing.csv")])


def test_sinks_roundtrip(spark):
    d = tempfile.mkdtemp()
    m = metrics_frame(spark, [{"model": "A", "RMSE": 1.0, "MAE": 0.5, "R2": 0.25}])
    write_metrics_csv(m, os.path.join(d, "m"))
    back = spark.read.option("header", True).csv(os.path.join(d, "m"))
    assert back.columns == ["model", "RMSE", "MAE", "MAPE", "R2", "training_time_sec"]
    assert back.first()["MAPE"] is None
    imp = spark.createDataFrame([("a", 0.1234567), ("b", 0.9)], "feature string, importance double")
    write_importance_csv(imp, os.path.join(d, "i"))
    rows = spark.read.option("header", True).csv(os.path.join(d, "i")).collect()
    assert [r["feature"] for r in rows] == ["b", "a"] and rows[1]["importance"] == "0.123457"


def test_stream_matches_batch(spark):
    from panelcast.operators.clean import clean_readings
    from panelcast.operators.impute import fill_values
    from panelcast.operators.index import compute_aqi
    from panelcast.streaming import indexed_stream
    src = tempfile.mkdtemp()
    rows = [["1", "d", "st", "S1", "ag", "t", "12", "30", "90", "NA", "m", "40", "2001-02-03"],
            ["2", "d", "st", "S1", "ag", "t", "NA", " none ", "120", "", "m", "", "04/05/2001"],
            ["3", "d", "st", "S2", "ag", "t", "junk", "45", "", "", "m", "61", "junk"]]
    with open(os.path.join(src, "part1.csv"), "w") as fh:
        fh.write(",".join(f.name for f in RAW_SCHEMA.fields) + "\n")
        for r in rows:
            fh.write(",".join(r) + "\n")
    medians = {"so2": 10.0, "no2": 20.0, "pm10": 100.0, "pm2_5": 50.0}
    stream = indexed_stream(spark, src, medians)
    q = stream.writeStream.format("memory").queryName("aqi_stream").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["stn_code"], r["AQI"]) for r in spark.sql("SELECT * FROM aqi_stream").collect())
    batch = compute_aqi(fill_values(clean_readings(read_readings(spark, src)), medians))
    want = sorted((r["stn_code"], r["AQI"]) for r in batch.collect())
    assert got == want and len(got) == 2


def test_staged_year_filter_prunes_partitions(spark):
    from panelcast.session import scratch_path
    from panelcast.sources.readings import stage_dataset
    staged = stage_dataset(lineitem_readings(spark, SF001), scratch_path(spark, "staged_prune_test"))
    q = staged.filter(F.col("year") <= 1997)
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        q.explain()
    assert "PartitionFilters: [isnotnull(year" in buf.getvalue()
    assert q.count() == staged.filter("year <= 1997").count() > 0


def test_csv_columns_by_header_name(spark):
    from panelcast.sources.readings import RAW_COLUMNS
    d = tempfile.mkdtemp()
    path = os.path.join(d, "r.csv")
    with open(path, "w") as fh:
        fh.write(",".join(["extra", *reversed(RAW_COLUMNS)]) + "\n" + ",".join(["x", *(f"v_{c}" for c in reversed(RAW_COLUMNS))]) + "\n")
    row = read_readings(spark, path).first().asDict()
    assert row == {c: f"v_{c}" for c in RAW_COLUMNS}
    with open(path, "w") as fh:
        fh.write("location,so2\nA,1\n")
    with pytest.raises(ValueError, match="date"):
        read_readings(spark, path)


def test_fallback_from_unknown_host(spark):
    d = tempfile.mkdtemp()
    path = os.path.join(d, "r.csv")
    with open(path, "w") as fh:
        fh.write(",".join(RAW_SCHEMA.names) + "\n" + ",".join("1" for _ in RAW_SCHEMA.names) + "\n")
    assert read_readings(spark, ["hdfs://no-such-host.invalid/x.csv", path]).count() == 1
    with pytest.raises(FileNotFoundError, match="no-such-host"):
        read_readings(spark, ["hdfs://no-such-host.invalid/x.csv"])


def test_non_finite_text_is_missing(spark):
    from panelcast.functions.tokens import clean_double
    df = spark.createDataFrame([("inf",), ("-Infinity",), ("1e400",), ("NaN",), ("2.5",)], "x string")
    assert [r[0] for r in df.select(clean_double("x")).collect()] == [None, None, None, None, 2.5]


def test_tie_breakers_are_mandatory():
    from panelcast.panel import PanelSpec
    with pytest.raises(ValueError, match="tie_breakers"):
        PanelSpec("city", "t")
    assert PanelSpec("city", "t", unique_time=True).order_cols == ["t"]


def test_group_filter_keeps_null_group(spark):
    from panelcast.operators.outliers import filter_iqr_by_group
    rows = [(None, float(i)) for i in range(10)] + [("a", 1.0), ("a", 1.0), ("a", 1.0), ("a", 1.0), ("a", 99.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    kept = filter_iqr_by_group(df, "x", "g").collect()
    assert sum(r["g"] is None for r in kept) == 10 and [r["x"] for r in kept if r["g"] == "a"] == [1.0] * 4


@pytest.mark.parametrize("name", ["LinearRegression", "RandomForest", "GBTRegressor"])
def test_models_find_a_known_relation(spark, name):
    from pyspark.ml.feature import VectorAssembler
    from panelcast.operators.evaluate import evaluate_models
    from panelcast.plans.models import train_models
    df = spark.range(1500).select((F.rand(1) * 10).alias("a"), (F.rand(2) * 10).alias("b"))
    df = df.withColumn(LABEL_COL, 3 * F.col("a") + F.when(F.col("b") > 5, 10.0).otherwise(0.0) + F.rand(3)).cache()
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    assert evaluate_models(train_models(vec, [name]), vec).first()["R2"] > 0.8


def test_inferred_schema_mode(spark):
    d = tempfile.mkdtemp()
    path = os.path.join(d, "r.csv")
    with open(path, "w") as fh:
        fh.write("location,so2,date\nA,NA,2001-01-02\nB,3.5,2001-01-03\n")
    df = read_readings(spark, path, schema=None, infer_schema=True)
    assert dict(df.dtypes)["so2"] == "string"  # "NA" makes inference fall back to text
    from panelcast.operators.clean import cast_numeric
    assert [r["so2"] for r in cast_numeric(df).orderBy("location").collect()] == [None, 3.5]


def test_forest_keeps_no_cache_of_node_ids():
    from panelcast.plans.models import ESTIMATORS
    forest = ESTIMATORS["RandomForest"]()
    assert not forest.getCacheNodeIds() and forest.getNumTrees() == 100 and forest.getMaxDepth() == 10


def test_preprocessing_reads_its_input_once(spark):
    """The medians, the bounds and the result read staged columns: the raw rows are evaluated by one job."""
    from panelcast.plans.pipeline import run_preprocessing
    raw = lineitem_readings(spark, SF001)
    seen = spark.sparkContext.accumulator(0)
    counted = raw.mapInPandas(lambda frames: ((seen.add(len(f)), f)[1] for f in frames), raw.schema)
    assert run_preprocessing(counted).count() > 0
    assert seen.value == raw.count()


def test_cross_entity_folds_read_their_input_once(spark):
    from panelcast.operators.clean import clean_readings
    from panelcast.plans.crossval import cross_entity_forecast
    df = clean_readings(lineitem_readings(spark, SF001))
    seen = spark.sparkContext.accumulator(0)
    counted = df.mapInPandas(lambda frames: ((seen.add(len(f)), f)[1] for f in frames), df.schema)
    out = cross_entity_forecast(counted, READINGS_SPEC, 2, "LinearRegression", ["AQI_lag1"], scale=False, params={"regParam": 0.0, "solver": "normal"})
    assert out.count() == 2 and seen.value == df.count()


def test_sequences_are_gathered_only_where_read(spark, feats):
    """The label's scaler takes no sequence, and vectors of known width are not made to learn it."""
    from panelcast.operators.sequences import sequence_windows
    seq = sequence_windows(feats[0], READINGS_SPEC, FEATURE_COLUMNS, LABEL_COL, 4, offset=0)
    assert "collect_list" not in seq.select(LABEL_COL)._jdf.queryExecution().optimizedPlan().toString()
    assert seq.select(LABEL_COL).count() == seq.filter(F.size("seq") == 4).count() > 0
    vectors = sequence_vectors(seq, width=52)
    assert vectors.schema["features"].metadata["ml_attr"]["num_attrs"] == 52
    model, _ = fit_sequence_regression(seq, LABEL_COL, width=52)
    assert model.numFeatures == 52
