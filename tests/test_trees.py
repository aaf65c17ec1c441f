"""Forests on binned rows against MLlib's, and their parts."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from panelcast.operators.evaluate import evaluate_models
from panelcast.operators.features import LABEL_COL
from panelcast.plans import trees
from panelcast.plans.models import train_models

WHOLE = {"numTrees": 1, "bootstrap": False, "featureSubsetStrategy": "all", "subsamplingRate": 1.0}


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(0, 4000, 1, 3).select((F.rand(1) * 10).alias("a"), F.floor(F.rand(2) * 5).cast("double").alias("b"),
                                           F.rand(3).alias("c"), F.lit(7.0).alias("same"))
    df = df.withColumn(LABEL_COL, 100 + 3 * F.col("a") * F.col("b") + F.when(F.col("c") > 0.5, 20.0).otherwise(0.0) + F.randn(4))
    return VectorAssembler(inputCols=["a", "b", "c", "same"], outputCol="features").transform(df).cache()


def _own(rows, **params):
    return train_models(rows, ["RandomForest"], params={"RandomForest": params})["RandomForest"][0]


def test_one_tree_is_mllibs_tree(spark, rows):
    own = _own(rows, maxDepth=6, **WHOLE)
    theirs = RandomForestRegressor(featuresCol="features", labelCol=LABEL_COL, maxDepth=6, seed=42, **WHOLE).fit(rows)
    assert [t.numNodes for t in own.trees] == [t.numNodes for t in theirs.trees]
    assert own.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), rel=1e-9)
    both = theirs.setPredictionCol("p").transform(own.transform(rows))
    assert both.agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0] < 1e-9
    assert own.getMaxDepth() == 6 and own.numFeatures == 4 and own.getLabelCol() == LABEL_COL


def test_forest_is_fitted_without_mllibs_rows(spark, rows, monkeypatch):
    """MLlib's trainer keeps a count per row and tree; it takes no part in a forest's fit."""
    theirs = RandomForestRegressor(featuresCol="features", labelCol=LABEL_COL, numTrees=20, maxDepth=6, seed=42).fit(rows)
    monkeypatch.setattr(RandomForestRegressor, "_fit_java", lambda *a: pytest.fail("fitted by MLlib"))
    own = _own(rows, numTrees=20, maxDepth=6)
    r2 = {r["model"]: r["R2"] for r in evaluate_models({"own": (own, 0.0), "theirs": (theirs, 0.0)}, rows).collect()}
    assert own.getNumTrees == 20 and r2["own"] == pytest.approx(r2["theirs"], abs=0.03)


def test_statistics_in_several_lots_give_the_same_forest(spark, rows, monkeypatch):
    one = _own(rows, numTrees=4, maxDepth=5)
    monkeypatch.setattr(trees, "PART_NODES", 3)
    monkeypatch.setattr(trees, "_groups", lambda t, s, p, b, k, limit, f=trees._groups: f(t, s, p, b, k, 7 * p * b * 8 * k))
    assert _own(rows, numTrees=4, maxDepth=5).toDebugString.splitlines()[1:] == one.toDebugString.splitlines()[1:]


def test_draws_are_poisson_and_differ_by_tree():
    key = trees._mixed(np.arange(200_000, dtype=np.uint64))
    bag = trees.Bag(1.0, True, 42)
    a, b = bag.draws(key, 0).astype(float), bag.draws(key, 1).astype(float)
    assert a.mean() == pytest.approx(1, abs=0.02) and a.var() == pytest.approx(1, abs=0.03)
    assert (a == 0).mean() == pytest.approx(np.exp(-1), abs=0.01) and abs(np.corrcoef(a, b)[0, 1]) < 0.01
    assert (bag.draws(key[::-1], 0)[::-1] == a).all()
    assert trees.Bag(0.3, False, 1).draws(key, 0).mean() == pytest.approx(0.3, abs=0.01)


def test_split_points_and_refusals(spark, rows):
    assert trees.split_points(np.array([1.0, 3.0, 3.0, 7.0]), 5).tolist() == [2.0, 5.0]
    assert trees.split_points(np.array([4.0, 4.0]), 5).tolist() == []
    assert trees.split_points(np.arange(100.0), 3).tolist() == [24.5, 49.5, 74.5]
    assert [trees.subset_size(s, 13, 100) for s in ("auto", "all", "sqrt", "log2", "onethird", "4", "0.5")] == [5, 13, 4, 4, 5, 4, 7]
    with pytest.raises(Exception, match="NaN|Null|null"):
        _own(rows.withColumn(LABEL_COL, F.when(F.col("b") == 1, float("nan")).otherwise(1.0)), numTrees=1)
    with pytest.raises(Exception, match="none given"):
        _own(rows.filter("a < 0"), numTrees=1)


def test_constant_labels_make_leaves(spark, rows):
    model = _own(rows.withColumn(LABEL_COL, F.lit(5.25)), numTrees=3, maxDepth=3)
    assert model.totalNumNodes == 3 and model.transform(rows).select("prediction").distinct().collect() == [(5.25,)]
