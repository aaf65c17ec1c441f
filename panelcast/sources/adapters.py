"""Adapters that present driver tables as reading panels (FIXTURES.md §2, §3).

``lineitem_readings`` turns ``lineitem`` into a dirty raw-readings table: one
entity per supplier, text-typed concentrations with missing tokens, and dates
in four layouts. ``events_panel`` is the short single-year panel over
``events``. Both are plain projections, so scans prune columns and splits.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.panel import PanelSpec

# entity/time/tie-breakers that make the order unique within an entity
READINGS_SPEC = PanelSpec("city", "date_parsed", ("l_orderkey", "l_linenumber", "l_partkey"))
EVENTS_SPEC = PanelSpec("user_id", "ts", ("event_id",))


def _table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def _token(ok: Column, r: int, value: Column) -> Column:
    return (F.when(ok % 11 == r, F.lit("NA"))
            .when(ok % 13 == r, F.lit(" none "))
            .when(ok % 17 == r, F.lit(""))
            .otherwise(value.cast("string")))


def _half_floor(x: Column) -> Column:
    # floor to a multiple of 0.5: exact in binary, prints alike in every engine
    return F.floor(x * 2).cast("double") / 2.0


def lineitem_readings(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """``partitions`` deals the scanned numbers out, by a hash of the whole row, before any text is made of them,
    for a file that is few scan tasks."""
    li = _table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_shipdate"])
    if partitions is not None:
        li = li.repartition(partitions, *li.columns)  # by hash: dealing in turn would sort every task's rows first
    ok = F.col("l_orderkey")
    ship = F.col("l_shipdate")
    date = (F.when(ok % 97 == 0, F.lit("NA"))
            .when(ok % 4 == 0, F.date_format(ship, "yyyy-MM-dd"))
            .when(ok % 4 == 1, F.date_format(ship, "dd-MM-yyyy"))
            .when(ok % 4 == 2, F.date_format(ship, "MM/dd/yyyy"))
            .otherwise(F.date_format(ship, "yyyy/MM/dd")))
    pm25 = _half_floor(F.col("l_tax") * 4000 + F.col("l_linenumber") * 1.5)
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("location"),
        _token(ok, 0, F.col("l_quantity")).alias("so2"),
        _token(ok, 1, _half_floor(F.col("l_discount") * 1000)).alias("no2"),
        _token(ok, 2, _half_floor(F.col("l_extendedprice") / 200)).alias("rspm"),
        _token(ok, 3, _half_floor(F.col("l_extendedprice") / 100)).alias("spm"),
        F.when(ok % 3 == 0, F.lit("NA")).otherwise(pm25.cast("string")).alias("pm2_5"),
        date.alias("date"),
    )


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
