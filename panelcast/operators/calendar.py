"""Calendar mode (D6): one row per entity and day, then a lead that checks the gap.

In row mode "next day" means "next row", whatever its date. Calendar mode
first aggregates readings to one row per (entity, day) — a grouped
aggregate combined map-side — and then takes the value ``h`` rows ahead only
when it lies exactly ``h`` days ahead; otherwise the target is null.

Lags and rolling means by the calendar use ``RANGE`` frames over day numbers (``add_range_columns``):
an entity is cut into blocks of days, each with a halo of days, so the frame of a row always lies in
its block. The frames run over one row per (entity, day) that holds mergeable parts (sum and count),
made map-side; readings get them back by an equi-join, so an entity or a day that holds most rows is never
one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelcast.operators.windows import DEFAULT_CHUNK_ROWS, add_window_columns
from panelcast.panel import PanelSpec

AGGREGATES = {"avg": F.avg, "max": F.max, "min": F.min, "sum": F.sum}


def daily_panel(df: DataFrame, entity: str, date_col: str, value_cols: Sequence[str],
                how: str = "avg") -> DataFrame:
    """One row per (entity, day) with the ``how`` of each value column and a row count."""
    agg = AGGREGATES[how]
    return (df.filter(F.col(date_col).isNotNull())
            .groupBy(entity, F.to_date(date_col).alias(date_col))
            .agg(*[agg(c).alias(c) for c in value_cols], F.count(F.lit(1)).alias("readings")))


def calendar_target(daily: DataFrame, entity: str, date_col: str, col: str, days: int = 1,
                    out: str | None = None, drop_null: bool = True, strategy: str = "auto",
                    chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """``out`` = value ``days`` calendar days later (null when that day has no row).

    The frame is bounded (``days`` rows ahead at most, since dates are
    unique per entity), so the skew-safe window engine applies.
    """
    out = out or f"{col}_target_{days}d"
    spec = PanelSpec(entity, date_col, unique_time=True)
    cols = {f"_pc_v{k}": (lambda k: lambda w: F.lead(col, k).over(w))(k) for k in range(1, days + 1)}
    cols.update({f"_pc_d{k}": (lambda k: lambda w: F.lead(date_col, k).over(w))(k) for k in range(1, days + 1)})
    led = add_window_columns(daily, spec, cols, lookback=0, lookahead=days, strategy=strategy,
                             chunk_rows=chunk_rows)
    target = F.coalesce(*[F.when(F.datediff(F.col(f"_pc_d{k}"), F.col(date_col)) == days, F.col(f"_pc_v{k}"))
                          for k in range(1, days + 1)])
    res = led.withColumn(out, target).drop(*cols)
    return res.filter(F.col(out).isNotNull()) if drop_null else res


#: Days of a block; a block and its halo are the rows of one window partition.
BLOCK_DAYS = 1_024


def add_range_columns(df: DataFrame, entity: str, date_col: str, columns: Mapping[str, Callable[[WindowSpec], Column]],
                      days_back: int, days_ahead: int = 0, block_days: int = BLOCK_DAYS) -> DataFrame:
    """Columns over frames of calendar days: ``lambda w: F.sum("x").over(w.rangeBetween(-23, 0))`` is
    the sum from 23 days before to the row's own day, whatever rows there are.

    Frames must stay within ``days_back`` and ``days_ahead`` days. Windows are partitioned by (entity, block of days)
    and rows near a border are copied to the blocks whose frames reach them; a null entity is an entity, rows
    without a date get null columns.
    """
    if block_days < 1 or days_back < 0 or days_ahead < 0:
        raise ValueError("block_days must be at least 1, days_back and days_ahead not negative")
    day = F.datediff(F.to_date(date_col), F.lit("1970-01-01").cast("date"))
    dated = df.filter(F.col(date_col).isNotNull()).withColumn("_pc_day", day)
    own = F.floor(F.col("_pc_day") / block_days)
    # a row lies in the frames of the days from day - days_ahead to day + days_back
    blocks = F.sequence(F.floor((F.col("_pc_day") - days_ahead) / block_days), F.floor((F.col("_pc_day") + days_back) / block_days))
    copies = dated.withColumn("_pc_block", F.explode(blocks))
    w = Window.partitionBy(F.col(entity), "_pc_block").orderBy("_pc_day")
    out = copies.withColumns({name: fn(w) for name, fn in columns.items()})
    out = out.filter(F.col("_pc_block") == own).drop("_pc_block", "_pc_day")
    undated = df.filter(F.col(date_col).isNull())
    return out.unionByName(undated, allowMissingColumns=True)


def calendar_features(df: DataFrame, entity: str, date_col: str, col: str, lag_days: Sequence[int] = (1, 24),
                      rolling_days: Sequence[int] = (24,), block_days: int = BLOCK_DAYS) -> DataFrame:
    """W2-W4 by the calendar: ``{col}_lag{k}d``, the mean of the day exactly ``k`` days before (null if it has
    no reading), and ``{col}_rolling_{n}d``, the mean of all readings of the ``n`` days that end with the row's own.

    Null and NaN readings count for nothing. A reading without a date has null features; a null entity is an entity.
    """
    value = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    day = F.to_date(date_col)
    daily = (df.filter(F.col(date_col).isNotNull()).groupBy(F.col(entity).alias("_pc_e"), day.alias("_pc_d"))
             .agg(F.sum(value).alias("_pc_s"), F.count(value).alias("_pc_n")))

    def mean(first: int, last: int):
        def build(w):
            frame = w.rangeBetween(first, last)
            return F.try_divide(F.sum("_pc_s").over(frame), F.sum("_pc_n").over(frame))
        return build

    columns = {f"{col}_lag{k}d": mean(-k, -k) for k in lag_days}
    columns.update({f"{col}_rolling_{n}d": mean(1 - n, 0) for n in rolling_days})
    back = max([*lag_days, *(n - 1 for n in rolling_days), 0])
    made = add_range_columns(daily, "_pc_e", "_pc_d", columns, back, block_days=block_days).drop("_pc_s", "_pc_n")
    same = F.col(entity).eqNullSafe(F.col("_pc_e")) & (day == F.col("_pc_d"))
    return df.drop(*columns).join(made, same, "left").drop("_pc_e", "_pc_d")
