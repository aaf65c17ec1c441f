"""Breakpoint-based sub-indices and the air-quality index.

A sub-index is piecewise linear in the concentration C:
``I = (Ihi - Ilo) / (BPhi - BPlo) * (C - BPlo) + Ilo`` on the first segment
with ``BPlo <= C <= BPhi``; ``C`` above the last ``BPhi`` gives 500; anything
else (negative values, the gaps between segments such as 30 < C < 31) gives
null. The index is the null-skipping maximum of the sub-indices.

Each concentration is bound once through a one-element ``transform`` lambda.
Written as a plain CASE chain, Catalyst pushes ``AQI IS NOT NULL`` and range
filters below the projections and inlines the cleaned column into every
branch, which overflows the 64 KB codegen method limit; the lambda keeps the
expression small and inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# CPCB (India) sub-index breakpoints, (BPlo, BPhi, Ilo, Ihi) per segment,
# in segment order. Concentrations in ug/m3.
PM25_BREAKPOINTS = (
    (0, 30, 0, 50),
    (31, 60, 51, 100),
    (61, 90, 101, 200),
    (91, 120, 201, 300),
    (121, 250, 301, 400),
    (250, 500, 401, 500),
)
PM10_BREAKPOINTS = (
    (0, 50, 0, 50),
    (51, 100, 51, 100),
    (101, 250, 101, 200),
    (251, 350, 201, 300),
    (351, 430, 301, 400),
    (430, 600, 401, 500),
)
SO2_BREAKPOINTS = (
    (0, 40, 0, 50),
    (41, 80, 51, 100),
    (81, 380, 101, 200),
    (381, 800, 201, 300),
    (801, 1600, 301, 400),
    (1600, 2400, 401, 500),
)
NO2_BREAKPOINTS = (
    (0, 40, 0, 50),
    (41, 80, 51, 100),
    (81, 180, 101, 200),
    (181, 280, 201, 300),
    (281, 400, 301, 400),
    (400, 600, 401, 500),
)
# Index value for concentrations above the last segment.
INDEX_CAP = 500.0

BREAKPOINTS: dict[str, Sequence[tuple[int, int, int, int]]] = {
    "pm2_5": PM25_BREAKPOINTS,
    "pm10": PM10_BREAKPOINTS,
    "so2": SO2_BREAKPOINTS,
    "no2": NO2_BREAKPOINTS,
}

GAP_POLICIES = ("null", "round")


def _piecewise(x: Column, table: Sequence[tuple[int, int, int, int]], nan_to_null: bool) -> Column:
    """First segment that holds ``x``, each interpolating between its two index values by
    the share of the segment that ``x`` has covered; the cap beyond the last one."""
    share = [(x - F.lit(float(lo))) / F.lit(float(hi - lo)) for lo, hi, _, _ in table]
    parts = [F.when(x.between(lo, hi), F.lit(float(ilo)) + part * F.lit(float(ihi - ilo)))
             for part, (lo, hi, ilo, ihi) in zip(share, table)]
    beyond = x > F.lit(float(table[-1][1]))
    if nan_to_null:
        beyond = beyond & ~F.isnan(x)
    return F.coalesce(*parts, F.when(beyond, F.lit(INDEX_CAP)))


def _binder(table, gap_policy: str, nan_to_null: bool):
    # A factory, not a default argument: F.transform counts defaults as lambda params.
    def fn(x: Column) -> Column:
        if gap_policy == "round":
            x = F.round(x, 0)
        return _piecewise(x, table, nan_to_null)
    return fn


def sub_index(c: str | Column, table: Sequence[tuple[int, int, int, int]],
              gap_policy: str = "null", compat: bool = False, bind: bool = True) -> Column:
    """Sub-index of one concentration column.

    ``gap_policy="null"`` keeps the reference behaviour on segment gaps;
    ``"round"`` rounds C to an integer first. NaN gives null unless
    ``compat=True`` (then NaN compares above every segment and gives 500).

    ``bind=True`` evaluates the input once through a lambda: safe when the
    input is an unmaterialised expression (it is inlined into pushed-down
    filters), but interpreted. ``bind=False`` emits the plain CASE chain,
    4-6x faster under whole-stage codegen; use it when the concentrations
    are materialised (read from storage, persisted or checkpointed).
    """
    if gap_policy not in GAP_POLICIES:
        raise ValueError(f"gap_policy must be one of {GAP_POLICIES}")
    col = (F.col(c) if isinstance(c, str) else c).cast("double")
    fn = _binder(table, gap_policy, not compat)
    if not bind:
        return fn(col)
    return F.element_at(F.transform(F.array(col), fn), 1)


def aqi_expr(columns: Mapping[str, str] | None = None, gap_policy: str = "null",
             compat: bool = False, bind: bool = True) -> Column:
    """Null-skipping max of the sub-indices; null only when all are null.

    ``columns`` maps a pollutant key of ``BREAKPOINTS`` to its column name.
    """
    columns = dict(columns or {k: k for k in BREAKPOINTS})
    parts = [sub_index(col, BREAKPOINTS[key], gap_policy, compat, bind) for key, col in columns.items()]
    if len(parts) == 1:
        return parts[0]
    return F.greatest(*parts)


def breakpoint_table(spark: SparkSession) -> DataFrame:
    """The breakpoint constants as a small DataFrame (pollutant, segment, ...)."""
    rows = [(p, i, float(lo), float(hi), float(ilo), float(ihi))
            for p, table in BREAKPOINTS.items() for i, (lo, hi, ilo, ihi) in enumerate(table)]
    return spark.createDataFrame(
        rows, "pollutant string, segment int, bp_lo double, bp_hi double, i_lo double, i_hi double")
