"""Feature vectors, estimators, training, importances, sequence regression
(M1-M7, M10, M14). Estimators and models are MLlib's; forests are fitted on binned rows (``plans/trees.py``)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.features import FEATURE_COLUMNS, LABEL_COL
from panelcast.plans.trees import fit_forest

SEED = 42

# Estimator settings of the studied runs.
LINEAR_PARAMS = {"maxIter": 100, "regParam": 0.1, "elasticNetParam": 0.8}
FOREST_PARAMS = {"numTrees": 100, "maxDepth": 10, "seed": SEED}
GBT_PARAMS = {"maxIter": 100, "maxDepth": 5, "seed": SEED}
# Execution-only setting (same model, checked): node ids are found by walking the trees. A cache of them is
# an id a row and tree, three generations of which are kept and every tenth written out: 400 bytes a row each.
FOREST_PARAMS_EXEC = {"cacheNodeIds": False}


def _estimator(cls, defaults):
    def make(features: str = "features", label: str = LABEL_COL, **overrides):
        return cls(featuresCol=features, labelCol=label, **{**defaults, **overrides})
    return make


ESTIMATORS: dict[str, Callable[..., object]] = {
    "LinearRegression": _estimator(LinearRegression, LINEAR_PARAMS),
    "RandomForest": _estimator(RandomForestRegressor, {**FOREST_PARAMS, **FOREST_PARAMS_EXEC}),
    "GBTRegressor": _estimator(GBTRegressor, GBT_PARAMS),
}


def feature_pipeline(feature_cols: Sequence[str] = FEATURE_COLUMNS, scale: bool = True,
                     out: str = "features", handle_invalid: str = "error") -> Pipeline:
    """M1/M2: assemble (and standardise with mean and sample std) the inputs."""
    if not scale:
        return Pipeline(stages=[VectorAssembler(inputCols=list(feature_cols), outputCol=out,
                                                handleInvalid=handle_invalid)])
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(feature_cols), outputCol=f"{out}_raw",
                        handleInvalid=handle_invalid),
        StandardScaler(inputCol=f"{out}_raw", outputCol=out, withMean=True, withStd=True),
    ])


def fit_features(fit_df: DataFrame, feature_cols: Sequence[str] = FEATURE_COLUMNS,
                 scale: bool = True, **kw) -> PipelineModel:
    """Fit the assembler/scaler (on the training rows, to keep test statistics out)."""
    return feature_pipeline(feature_cols, scale, **kw).fit(fit_df)


def fit_estimator(est, df: DataFrame):
    """``est.fit(df)``; a forest by the level-wise plan, whose cost doesn't depend on keeping the rows in memory."""
    return fit_forest(est, df) if isinstance(est, RandomForestRegressor) else est.fit(df)


def train_models(train_df: DataFrame, names: Iterable[str] = tuple(ESTIMATORS),
                 label: str = LABEL_COL, features: str = "features",
                 params: Mapping[str, Mapping[str, object]] | None = None
                 ) -> dict[str, tuple[object, float]]:
    """M3-M6: fit each estimator in turn on the same (persisted) training set.
    Returns ``{name: (model, seconds)}``."""
    params = params or {}
    out = {}
    for name in names:
        est = ESTIMATORS[name](features=features, label=label, **dict(params.get(name, {})))
        start = time.perf_counter()
        model = fit_estimator(est, train_df)
        out[name] = (model, time.perf_counter() - start)
    return out


def feature_importance(spark: SparkSession, model, feature_names: Sequence[str] = FEATURE_COLUMNS
                       ) -> DataFrame:
    """(feature, importance), importance desc then name."""
    values = model.featureImportances.toArray().tolist()
    rows = list(zip(feature_names, (float(v) for v in values)))
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.desc("importance"), F.asc("feature"))


def linear_coefficients(spark: SparkSession, model, feature_names: Sequence[str] = FEATURE_COLUMNS
                        ) -> DataFrame:
    rows = [(n, float(c)) for n, c in zip(feature_names, model.coefficients.toArray().tolist())]
    rows.append(("intercept", float(model.intercept)))
    return spark.createDataFrame(rows, "feature string, coefficient double")


def sequence_vectors(seq_df: DataFrame, seq_col: str = "seq", out: str = "features", width: int | None = None) -> DataFrame:
    """M14 input: flatten the (window x features) sequence into one vector (JVM-side). With the vectors' ``width``
    (window times features) an estimator needn't make the first one, with all work before it, to learn it."""
    vector = array_to_vector(F.flatten(F.col(seq_col)))
    return seq_df.withColumn(out, vector if width is None else vector.alias(out, metadata={"ml_attr": {"num_attrs": width}}))


def fit_sequence_regression(train_seq: DataFrame, label: str, estimator: str = "LinearRegression",
                            seq_col: str = "seq", width: int | None = None, **params):
    """The sequence-model comparison as a distributed regressor on flattened windows (of ``width`` numbers)."""
    est = ESTIMATORS[estimator](features="features", label=label, **params)
    start = time.perf_counter()
    model = fit_estimator(est, sequence_vectors(train_seq, seq_col, width=width))
    return model, time.perf_counter() - start
