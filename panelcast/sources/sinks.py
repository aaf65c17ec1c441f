"""Result sinks (S4-S6) and preview (S8). Results are tiny (one row per model or
feature), so they are written as a single CSV part with a fixed header."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

METRIC_FIELDS = ("model", "RMSE", "MAE", "MAPE", "R2", "training_time_sec")


def metrics_schema(*extra: str) -> StructType:
    """Columns of a metrics table, further text columns (an entity) after them."""
    return StructType([StructField("model", StringType(), False)]
                      + [StructField(c, DoubleType(), True) for c in METRIC_FIELDS[1:]]
                      + [StructField(c, StringType(), True) for c in extra])


IMPORTANCE_SCHEMA = StructType([StructField("feature", StringType(), False),
                                StructField("importance", DoubleType(), True)])


def metrics_frame(spark: SparkSession, rows: Iterable[Mapping[str, object]],
                  extra: Iterable[str] = ()) -> DataFrame:
    """Metric dicts -> DataFrame with the fixed schema; missing keys are null."""
    fields = metrics_schema(*extra).fields
    names = [f.name for f in fields]
    data = [tuple(None if r.get(k) is None else (float(r[k]) if isinstance(f.dataType, DoubleType)
                                                 else str(r[k]))
                  for k, f in zip(names, fields)) for r in rows]
    return spark.createDataFrame(data, StructType(fields))


def _write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    """Fixed column order; MAPE and time rounded to 2 decimals as reported."""
    extra = [c for c in metrics.columns if c not in METRIC_FIELDS]
    out = metrics.select(
        "model", "RMSE", "MAE", F.round("MAPE", 2).alias("MAPE"), "R2",
        F.round("training_time_sec", 2).alias("training_time_sec"), *extra)
    _write_csv(out.orderBy("model"), path)


def write_importance_csv(importance: DataFrame, path: str) -> None:
    """``feature,importance`` sorted by importance desc, 6 decimals."""
    out = (importance.select("feature", F.round("importance", 6).alias("importance"))
           .orderBy(F.desc("importance"), F.asc("feature")))
    _write_csv(out, path)


def preview(df: DataFrame, columns: Iterable[str] | None = None, n: int = 5) -> DataFrame:
    cols = [c for c in (columns or df.columns) if c in df.columns]
    return df.select(*cols).limit(n)
