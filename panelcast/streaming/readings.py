"""Clean and index readings arriving as files in a directory (stateless)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from panelcast.operators.clean import COLUMN_RENAMES, ENTITY_RENAME, cast_numeric, parse_dates, rename_columns
from panelcast.operators.impute import fill_values
from panelcast.operators.index import compute_aqi
from panelcast.sources.readings import RAW_SCHEMA


def indexed_stream(spark: SparkSession, source_dir: str, medians: Mapping[str, float],
                   schema: StructType = RAW_SCHEMA, fmt: str = "csv",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of cleaned, dated, median-filled rows with ``AQI``."""
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(source_dir)
    df = parse_dates(cast_numeric(rename_columns(raw, {**COLUMN_RENAMES, **ENTITY_RENAME})))
    return compute_aqi(fill_values(df, medians))
