"""Column-expression builders (JVM-side, codegen-friendly; no Python UDFs)."""

from panelcast.functions.breakpoints import (
    BREAKPOINTS,
    aqi_expr,
    breakpoint_table,
    sub_index,
)
from panelcast.functions.dates import DATE_FORMATS, parse_date
from panelcast.functions.metrics import metric_aggregates
from panelcast.functions.tokens import NULL_TOKENS, clean_double, null_if_token

__all__ = [
    "BREAKPOINTS", "aqi_expr", "breakpoint_table", "sub_index",
    "DATE_FORMATS", "parse_date", "metric_aggregates",
    "NULL_TOKENS", "clean_double", "null_if_token",
]
