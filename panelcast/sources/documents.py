"""Readings that arrive as JSON documents with a map of pollutants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.clean import POLLUTANTS

#: A station's document; concentrations are text or numbers, as stations write them.
DOCUMENT = "location string, date string, readings map<string, string>, bad string"


def json_readings(docs: DataFrame, column: str = "document", pollutants: Sequence[str] = POLLUTANTS) -> DataFrame:
    """``docs`` with location, date and one text column per pollutant instead of the JSON, and ``bad``: whether
    the text is no JSON document of that form (a null document is bad, too).

    A pollutant that a document lacks is null, as is a JSON null; other fields and pollutants are left out. Columns so
    named are replaced. Bad documents keep their row, with nulls, so they can be counted and kept apart.
    """
    named = ["location", "date", *pollutants, "bad"]
    parsed = F.from_json(F.col(column), DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    kept = [c for c in docs.columns if c != column and c not in named]
    rows = docs.select(*kept, F.col(column).alias("_text"), parsed.alias("_doc"))
    bad = F.col("_text").isNull() | F.col("_doc").isNull() | F.col("_doc.bad").isNotNull()
    value = lambda c: F.when(~bad, c)
    return rows.select(*kept, value(F.col("_doc.location")).alias("location"), value(F.col("_doc.date")).alias("date"),
                       *[value(F.try_element_at(F.col("_doc.readings"), F.lit(p))).alias(p) for p in pollutants], bad.alias("bad"))


def document_counts(readings: DataFrame) -> DataFrame:
    """One row: documents, and bad ones among them."""
    return readings.agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("bad"), 1)).alias("bad"))
