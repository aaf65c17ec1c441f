"""Statistics of any period from a stored table of mergeable daily states (A1-A3, A10).

A day's values of a column are kept as cells of relative width: cell ``k`` holds values
in ``(g^(k-1), g^k]`` with ``g = (1 + error) / (1 - error)``, negatives mirrored, zeros and infinities in
cells of their own. Each cell stores its count, mean, sum of squared deviations and its
least and largest value; states add up, so rows that arrive later are appended as states of their own and a
period is a merge of its days. A state's size depends on the range of the values, not on the rows of a day.

Counts, means, deviations and extremes of a period are exact (up to rounding). A quantile
lies between the ``low`` and ``high`` of its cell, both values that occur; ``value`` is off by at most ``error`` times the
quantile. ``exact_period_quantiles`` starts from these ends and reads only the rows between them.

Nulls and NaN are counted as missing. A null day belongs only to a period that is open at both ends.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from panelcast.operators.outliers import IQRBounds
from panelcast.operators.quantiles import exact_quantiles

ERROR = 0.01
#: Added to cell numbers, so that those of positive values are positive.
_SHIFT = 1 << 28
_INFINITE = (1 << 31) - 1


class Period(NamedTuple):
    """Days from ``first`` to ``last``, both included; ``None`` leaves an end open."""

    name: str
    first: dt.date | None = None
    last: dt.date | None = None

    def holds(self, day: Column) -> Column:
        if self.first is None and self.last is None:
            return F.lit(True)
        tests = [day >= F.lit(self.first)] if self.first is not None else []
        tests += [day <= F.lit(self.last)] if self.last is not None else []
        return tests[0] & tests[1] if len(tests) == 2 else tests[0]


def _cell(x: Column, error: float) -> Column:
    size = F.abs(x)
    number = F.ceil(F.log(size) / F.lit(math.log((1 + error) / (1 - error)))) + _SHIFT
    number = F.when(size == F.lit(math.inf), F.lit(_INFINITE)).otherwise(number)
    return F.when(x == 0, 0).when(x < 0, -number).otherwise(number).cast("int")


def daily_stats(df: DataFrame, day: str, columns: Sequence[str], by: str | None = None, error: float = ERROR) -> DataFrame:
    """States of every (day, group, column): ``day, [by,] column, cell, n, mean, m2, low, high``.

    ``cell`` is null in the row that counts missing values. One aggregate, combined map-side;
    an empty table gives no rows.
    """
    if not 1e-6 <= error < 0.5:
        raise ValueError(f"error must be from 1e-6 to below 0.5, got {error}")
    keys = [by] if by else []
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("x")) for c in columns])
    rows = df.select(F.col(day).cast("date").alias("day"), *keys, F.explode(cells).alias("_v")).select("day", *keys, "_v.*")
    finite = F.when(F.abs("x") != F.lit(math.inf), F.col("x"))
    return rows.groupBy("day", *keys, "column", _cell(F.col("x"), error).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), (F.var_pop(finite) * F.count(finite)).alias("m2"), F.min("x").alias("low"), F.max("x").alias("high"))


def write_daily_stats(stats: DataFrame, path: str, mode: str = "append") -> None:
    """Append states to a stored table with a folder a month. Appending the same rows twice counts them twice."""
    stats.withColumn("month", F.date_format("day", "yyyy-MM")).repartition("month").write.mode(mode).partitionBy("month").parquet(path)


def read_daily_stats(spark: SparkSession, path: str, periods: Sequence[Period] = ()) -> DataFrame:
    """The stored states; with ``periods``, only the months they touch are read."""
    stats = spark.read.option("basePath", path).parquet(path).withColumn("month", F.col("month").cast("string"))
    if periods and all(p.first is not None for p in periods):
        stats = stats.filter(F.col("month") >= min(p.first for p in periods).strftime("%Y-%m"))
    if periods and all(p.last is not None for p in periods):
        stats = stats.filter(F.col("month") <= max(p.last for p in periods).strftime("%Y-%m"))
    return stats.drop("month")


def _in_periods(stats: DataFrame, periods: Sequence[Period]) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(p.holds(F.col("day")), F.lit(p.name)) for p in periods]))
    return stats.select(F.explode(names).alias("period"), "*")


def _totals(met: DataFrame, keys: list[str]) -> DataFrame:
    return met.groupBy("period", *keys, "column").agg(
        F.coalesce(F.sum(F.when(F.col("cell").isNotNull(), F.col("n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("cell").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum(F.when(F.col("cell").isNotNull(), F.col("n")))).alias("mean"), F.min("low").alias("min"), F.max("high").alias("max"))


def period_moments(stats: DataFrame, periods: Sequence[Period], by: str | None = None) -> DataFrame:
    """``period, [by,] column, n, missing, mean, std, min, max`` (sample deviation, null below two values;
    null if a value is infinite). Deviations are added about the period's mean, so nothing cancels."""
    keys = [by] if by else []
    met = _in_periods(stats, periods)
    total = _totals(met, keys)
    t = total.select(F.col("period").alias("_p"), *[F.col(k).alias("_k") for k in keys], F.col("column").alias("_c"), F.col("mean").alias("_mean"))
    same = (met["period"] == t["_p"]) & (met["column"] == t["_c"])
    if by:
        same &= met[by].eqNullSafe(t["_k"])
    m2 = met.join(t, same).groupBy("period", *keys, "column").agg(
        F.sum(F.when(F.col("cell").isNotNull(), F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2)).alias("_m2"))
    m2 = m2.select(F.col("period").alias("_p"), *[F.col(k).alias("_k") for k in keys], F.col("column").alias("_c"), "_m2")
    same = (total["period"] == m2["_p"]) & (total["column"] == m2["_c"])
    if by:
        same &= total[by].eqNullSafe(m2["_k"])
    infinite = (F.abs("min") == F.lit(math.inf)) | (F.abs("max") == F.lit(math.inf))
    std = F.when((F.col("n") > 1) & ~infinite, F.sqrt(F.col("_m2") / (F.col("n") - 1)))
    return total.join(m2, same).select("period", *keys, "column", "n", "missing", "mean", std.alias("std"), "min", "max")


def period_quantiles(stats: DataFrame, periods: Sequence[Period], probs: Sequence[float], by: str | None = None) -> DataFrame:
    """``period, [by,] column, prob, value, low, high, rank, below``: the discrete quantile lies in [low, high],
    ``below`` values are less than ``low`` and it has ``rank``. Columns without values give no rows.
    The windows run over merged cells, at most some thousands a (period, group, column)."""
    keys = [by] if by else []
    cells = _in_periods(stats, periods).filter("cell is not null").groupBy("period", *keys, "column", "cell").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    w = Window.partitionBy("period", *keys, "column")
    cells = cells.select("*", F.sum("n").over(w).alias("_all"), F.sum("n").over(w.orderBy("low").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"))
    cells = cells.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    rank = F.least(F.greatest(F.ceil(F.col("prob") * F.col("_all")), F.lit(1)), F.col("_all")).cast("long")
    below = F.col("_upto") - F.col("n")
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") * 2 / (1 + F.col("low") / F.col("high")))
    return cells.filter((F.col("_upto") >= rank) & (below < rank)).select(
        "period", *keys, "column", "prob", value.alias("value"), "low", "high", rank.alias("rank"), below.alias("below"))


def exact_period_quantiles(df: DataFrame, day: str, stats: DataFrame, period: Period, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list]:
    """``{column: [value per prob]}`` of the rows of ``df`` in a period, ``None`` for a column without values.

    ``stats`` are the daily states of the same rows. Quantiles whose cell holds one value need no pass;
    the others narrow from the ends of their cell, so the count and the wide first histogram of ``exact_quantiles``
    are not made again. The columns must be doubles, as the states are.
    """
    wrong = [c for c in columns if not isinstance(df.schema[c].dataType, DoubleType)]
    if wrong:
        raise ValueError(f"columns must be doubles: {wrong}")
    place = {float(p): [j for j, q in enumerate(probs) if float(q) == float(p)] for p in probs}
    start = {(c, j): None for c in columns for j in range(len(probs))}
    found = period_quantiles(stats.filter(F.col("column").isin(list(columns))), [period], list(place))
    for r in found.collect():  # one a column and probability
        for j in place[r["prob"]]:
            start[r["column"], j] = (r["rank"], r["low"], r["high"], r["below"])
    return exact_quantiles(df.filter(period.holds(F.col(day).cast("date"))), columns, probs, start=start)


def period_medians(df: DataFrame, day: str, stats: DataFrame, period: Period, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians of a period for ``fill_values``; columns without values are left out."""
    return {c: v[0] for c, v in exact_period_quantiles(df, day, stats, period, columns, [0.5]).items() if v[0] is not None}


def period_iqr_bounds(df: DataFrame, day: str, stats: DataFrame, period: Period, column: str = "AQI", factor: float = 1.5) -> IQRBounds | None:
    """Exact IQR bounds of a period for ``filter_iqr``; ``None`` without values."""
    q1, q3 = exact_period_quantiles(df, day, stats, period, [column], [0.25, 0.75])[column]
    return None if q1 is None else IQRBounds(q1, q3, factor)
