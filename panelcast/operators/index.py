"""Air-quality index columns (F6-F8 applied to a DataFrame)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from panelcast.functions.breakpoints import BREAKPOINTS, aqi_expr, sub_index


def compute_aqi(df: DataFrame, columns: Mapping[str, str] | None = None, out: str = "AQI",
                gap_policy: str = "null", compat: bool = False, bind: bool = True) -> DataFrame:
    """Add ``AQI``: null-skipping max of the pollutant sub-indices.
    ``bind=False`` when the concentrations are materialised (see ``sub_index``)."""
    columns = {k: v for k, v in (columns or {k: k for k in BREAKPOINTS}).items() if v in df.columns}
    return df.withColumn(out, aqi_expr(columns, gap_policy, compat, bind))


def add_sub_indices(df: DataFrame, prefix: str = "si_", gap_policy: str = "null",
                    compat: bool = False) -> DataFrame:
    """Each sub-index as its own column (``si_pm2_5``, ...)."""
    return df.withColumns({f"{prefix}{k}": sub_index(k, table, gap_policy, compat)
                           for k, table in BREAKPOINTS.items() if k in df.columns})
