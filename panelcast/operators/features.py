"""Forecast target, lag / rolling / cyclic / interaction features.

All window features share one (entity, time, tie-breakers) ordering, so
``panel_features`` computes the lead target, every lag and every rolling
mean in a single window pass: one shuffle and one sort for all of them.
The single-feature functions exist for use on their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.windows import DEFAULT_CHUNK_ROWS, add_window_columns
from panelcast.panel import PanelSpec

# Model inputs in assembly order (importances map onto this order).
FEATURE_COLUMNS = (
    "so2", "no2", "pm10", "pm2_5",
    "month", "day",
    "AQI_lag1", "AQI_lag24", "AQI_rolling_24",
    "month_sin", "month_cos",
    "pm25_x_so2", "no2_x_pm10",
)
LABEL_COL = "AQI_target"
INTERACTIONS = (("pm2_5", "so2", "pm25_x_so2"), ("no2", "pm10", "no2_x_pm10"))


def target_name(col: str) -> str:
    return f"{col}_target"


def lag_name(col: str, k: int) -> str:
    return f"{col}_lag{k}"


def rolling_name(col: str, n: int) -> str:
    return f"{col}_rolling_{n}"


def _rolling(col: str, n: int, min_periods: int):
    def build(w):
        frame = w.rowsBetween(-(n - 1), 0)
        avg = F.avg(col).over(frame)
        if min_periods <= 1:
            return avg
        return F.when(F.count(col).over(frame) >= min_periods, avg)
    return build


def panel_features(df: DataFrame, spec: PanelSpec, col: str = "AQI", horizon: int = 1,
                   lags: Sequence[int] = (1, 24), rolling: Sequence[int] = (24,),
                   min_periods: int = 1, drop_null_target: bool = True,
                   target: str | None = None, strategy: str = "auto",
                   chunk_rows: int = DEFAULT_CHUNK_ROWS,
                   target_time: str | None = None) -> DataFrame:
    """Lead target + lags + rolling means of ``col`` in one window pass.

    ``horizon`` rows ahead (not days: the reference's "next day" is the next
    row). Rolling means keep partial frames (``min_periods=1``), so only lags
    and the target create nulls. Rows without a target are dropped, which
    leaves every backward-looking feature of the other rows unchanged.
    ``target_time`` names an optional column holding the time of the row the
    target is taken from (used to purge labels that cross a split boundary).
    """
    target = target or target_name(col)
    cols = {target: lambda w: F.lead(col, horizon).over(w)}
    if target_time:
        cols[target_time] = lambda w: F.lead(spec.time, horizon).over(w)
    for k in lags:
        cols[lag_name(col, k)] = (lambda k: lambda w: F.lag(col, k).over(w))(k)
    for n in rolling:
        cols[rolling_name(col, n)] = _rolling(col, n, min_periods)
    lookback = max([*lags, *(n - 1 for n in rolling), 0])
    out = add_window_columns(df, spec, cols, lookback=lookback, lookahead=horizon,
                             strategy=strategy, chunk_rows=chunk_rows)
    return out.filter(F.col(target).isNotNull()) if drop_null_target else out


def forecast_target(df: DataFrame, spec: PanelSpec, col: str = "AQI", horizon: int = 1,
                    out: str | None = None, drop_null: bool = True, **kw) -> DataFrame:
    """``out = lead(col, horizon)``; rows without a future value dropped."""
    return panel_features(df, spec, col, horizon, lags=(), rolling=(), target=out,
                          drop_null_target=drop_null, **kw)


def lag_features(df: DataFrame, spec: PanelSpec, col: str = "AQI",
                 lags: Sequence[int] = (1, 24), **kw) -> DataFrame:
    """``{col}_lag{k}`` for every k."""
    cols = {lag_name(col, k): (lambda k: lambda w: F.lag(col, k).over(w))(k) for k in lags}
    return add_window_columns(df, spec, cols, lookback=max(lags), **kw)


def rolling_mean(df: DataFrame, spec: PanelSpec, col: str = "AQI", window_size: int = 24,
                 min_periods: int = 1, out: str | None = None, **kw) -> DataFrame:
    """Mean of the current row and the ``window_size - 1`` rows before it."""
    name = out or rolling_name(col, window_size)
    return add_window_columns(df, spec, {name: _rolling(col, window_size, min_periods)},
                              lookback=window_size - 1, **kw)


def cyclic_encoding(df: DataFrame, col: str = "month", period: float = 12.0,
                    prefix: str | None = None) -> DataFrame:
    """``sin/cos(2*pi*x/period)``."""
    prefix = prefix or col
    angle = F.lit(2 * math.pi) * F.col(col) / F.lit(float(period))
    return df.withColumns({f"{prefix}_sin": F.sin(angle), f"{prefix}_cos": F.cos(angle)})


def interactions(df: DataFrame, pairs: Iterable[tuple[str, str, str]] = INTERACTIONS) -> DataFrame:
    """products of column pairs, ``(left, right, output)``."""
    return df.withColumns({out: F.col(a) * F.col(b) for a, b, out in pairs})


def drop_incomplete(df: DataFrame, columns: Iterable[str] = (*FEATURE_COLUMNS, LABEL_COL)) -> DataFrame:
    """Drop rows with a null or NaN in any model input or the label."""
    return df.dropna(subset=list(columns))


def feature_table(df: DataFrame, spec: PanelSpec, drop_incomplete_rows: bool = True,
                  **kw) -> DataFrame:
    """The reference's full feature set on a cleaned, indexed panel."""
    out = panel_features(df, spec, "AQI", **kw)
    out = interactions(cyclic_encoding(out, "month"))
    return drop_incomplete(out) if drop_incomplete_rows else out
