"""Totals at several levels in one pass, and multiset comparison of splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.metrics import metric_aggregates


def metrics_by_levels(scored: DataFrame, levels: Sequence[Sequence[str]], label: str = "AQI_target",
                      prediction: str = "prediction") -> DataFrame:
    """RMSE, MAE, MAPE, R2 and n for every group of every level: ``[("city", "year"), ("city",), ()]``.

    The rows are read and shuffled once: an Expand makes a row per level, and the partial moments are merged map-side, so a
    level with one group (or a hot one) gathers a row per task. Columns that a level does not group by are null;
    ``level`` is the level's place in the list, so a null entity is told from a total.
    """
    keys = list(dict.fromkeys(c for level in levels for c in level))
    if not keys:
        return scored.agg(*metric_aggregates(label, prediction)).select(F.lit(0).alias("level"), "RMSE", "MAE", "MAPE", "R2", "n")
    made = scored.groupingSets([[F.col(c) for c in level] for level in levels], *[F.col(c) for c in keys]).agg(
        F.grouping_id().alias("_gid"), *metric_aggregates(label, prediction))
    # grouping_id has a bit per key, the first key highest, set where the level leaves the key out
    ids = [sum(1 << (len(keys) - 1 - i) for i, c in enumerate(keys) if c not in level) for level in levels]
    place = F.lit(None).cast("int")
    for i, gid in reversed(list(enumerate(ids))):
        place = F.when(F.col("_gid") == gid, i).otherwise(place)
    return made.select(place.alias("level"), *keys, "RMSE", "MAE", "MAPE", "R2", "n")


def split_audit(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows of either split, rows they share and rows of each alone, as multisets over ``columns``.

    Repeated rows count as often as they occur and nulls equal nulls (``INTERSECT ALL``, ``EXCEPT ALL``), so
    ``shared`` test rows are those a model has seen; shared and alone add up to each side.
    """
    a, b = train.select(*columns), test.select(*columns)
    parts = {"train_rows": a, "test_rows": b, "shared": a.intersectAll(b), "train_only": a.exceptAll(b), "test_only": b.exceptAll(a)}
    tagged = None
    for name, rows in parts.items():
        part = rows.select(F.lit(name).alias("part"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.agg(*[F.count(F.when(F.col("part") == name, 1)).alias(name) for name in parts])
