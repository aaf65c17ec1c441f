"""IQR outlier bounds, filter and flag.

Bounds are exact quantiles found by distributed selection, globally or per group
(``by``); an ``accuracy`` asks for quantile sketches instead. They are applied as literals
(global) or through a null-safe join on the group key (per group).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.quantiles import exact_group_quantiles, exact_quantiles


@dataclass(frozen=True)
class IQRBounds:
    q1: float
    q3: float
    factor: float

    @property
    def iqr(self) -> float:
        return self.q3 - self.q1

    @property
    def lower(self) -> float:
        return self.q1 - self.factor * self.iqr

    @property
    def upper(self) -> float:
        return self.q3 + self.factor * self.iqr


def _bound_columns(column: str, factor: float, accuracy: int) -> list[Column]:
    q = F.percentile_approx(F.col(column), [0.25, 0.75], accuracy)
    return [q[0].cast("double").alias("q1"), q[1].cast("double").alias("q3")]


def iqr_bounds_frame(df: DataFrame, column: str = "AQI", factor: float = 1.5,
                     by: str | None = None, accuracy: int | None = None) -> DataFrame:
    """q1, q3, iqr, lower, upper — one row, or one row per ``by`` group. Exact
    by default (per group: ``exact_group_quantiles``, no hot-group sketch merge);
    with an ``accuracy``, one grouped ``percentile_approx`` aggregate."""
    if by is None:
        b = fit_iqr_bounds(df, column, factor, accuracy)
        vals = (b.q1, b.q3, b.iqr, b.lower, b.upper) if b else (None,) * 5
        return df.sparkSession.createDataFrame(
            [vals], "q1 double, q3 double, iqr double, lower double, upper double")
    if accuracy is None:
        q = exact_group_quantiles(df, by, column, [0.25, 0.75])
        base = q.groupBy(by).agg(F.max(F.when(F.col("prob_idx") == 0, F.col("value"))).alias("q1"),
                                 F.max(F.when(F.col("prob_idx") == 1, F.col("value"))).alias("q3"))
    else:
        base = df.groupBy(by).agg(*_bound_columns(column, factor, accuracy))
    iqr = F.col("q3") - F.col("q1")
    return base.select(by, "q1", "q3", iqr.alias("iqr"),
                       (F.col("q1") - factor * iqr).alias("lower"),
                       (F.col("q3") + factor * iqr).alias("upper"))


def fit_iqr_bounds(df: DataFrame, column: str = "AQI", factor: float = 1.5,
                   accuracy: int | None = None) -> IQRBounds | None:
    """Global bounds (exact unless an ``accuracy`` is given); ``None`` on empty
    input (filters then pass rows through)."""
    if accuracy is None:
        q1, q3 = exact_quantiles(df, [column], [0.25, 0.75])[column]
    else:
        row = df.agg(*_bound_columns(column, factor, accuracy)).first()
        q1, q3 = (row["q1"], row["q3"]) if row is not None else (None, None)
    if q1 is None:
        return None
    return IQRBounds(float(q1), float(q3), factor)


def within(column: str, bounds: IQRBounds) -> Column:
    return F.col(column).between(F.lit(bounds.lower), F.lit(bounds.upper))


def filter_iqr(df: DataFrame, bounds: IQRBounds | None, column: str = "AQI") -> DataFrame:
    """Keep ``lower <= x <= upper``; null x drops (as in the reference)."""
    return df if bounds is None else df.filter(within(column, bounds))


def flag_outliers(df: DataFrame, bounds: IQRBounds | None, column: str = "AQI",
                  out: str = "is_outlier") -> DataFrame:
    """Flag instead of drop, so windows still see every reading."""
    if bounds is None:
        return df.withColumn(out, F.lit(False))
    return df.withColumn(out, ~F.coalesce(within(column, bounds), F.lit(False)))


def remove_outliers_iqr(df: DataFrame, column: str = "AQI", factor: float = 1.5,
                        accuracy: int | None = None) -> DataFrame:
    return filter_iqr(df, fit_iqr_bounds(df, column, factor, accuracy), column)


def filter_iqr_by_group(df: DataFrame, column: str, by: str, factor: float = 1.5,
                        accuracy: int | None = None) -> DataFrame:
    """Rows within their group's bounds, which are joined back on the group key (one row
    per group; a null group is a group)."""
    bounds = (iqr_bounds_frame(df, column, factor, by, accuracy)
              .select(F.col(by).alias("_pc_by"), F.col("lower").alias("_pc_lower"), F.col("upper").alias("_pc_upper")))
    joined = df.join(bounds, F.col(by).eqNullSafe(F.col("_pc_by")))
    return joined.filter(F.col(column).between(F.col("_pc_lower"), F.col("_pc_upper"))).drop("_pc_by", "_pc_lower", "_pc_upper")
