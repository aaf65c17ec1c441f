"""Renames, token cleaning, numeric casts and date parsing."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.dates import DATE_FORMATS, calendar_parts, parse_date
from panelcast.functions.tokens import NULL_TOKENS, clean_double, null_if_token

POLLUTANTS = ("so2", "no2", "pm10", "pm2_5")
NUMERIC_COLUMNS = (*POLLUTANTS, "spm")
COLUMN_RENAMES = {"rspm": "pm10"}   # RSPM is the PM10 reading in older station files
ENTITY_RENAME = {"location": "city"}


def rename_columns(df: DataFrame, mapping: Mapping[str, str] = COLUMN_RENAMES,
                   normalize_names: bool = False) -> DataFrame:
    """Rename present columns only; optionally lower-case + underscore all names."""
    renames = {k: v for k, v in mapping.items() if k in df.columns}
    if normalize_names:
        for c in df.columns:
            target = renames.get(c, c)
            renames[c] = "_".join(target.strip().lower().split())
    renames = {k: v for k, v in renames.items() if k != v}
    return df.withColumnsRenamed(renames) if renames else df


def rename_entity(df: DataFrame, src: str = "location", dst: str = "city") -> DataFrame:
    return rename_columns(df, {src: dst})


def cast_numeric(df: DataFrame, columns: Iterable[str] = NUMERIC_COLUMNS,
                 tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Text columns -> double; missing tokens and junk become null.

    Type-guarded like the reference: only present columns typed ``string``
    are touched, so already-numeric columns pass through.
    """
    types = dict(df.dtypes)
    todo = {c: clean_double(c, tokens) for c in columns if types.get(c) == "string"}
    return df.withColumns(todo) if todo else df


def parse_dates(df: DataFrame, date_col: str = "date", out: str = "date_parsed",
                formats: Sequence[str] = DATE_FORMATS, drop_unparsed: bool = True,
                tokens: Sequence[str] = NULL_TOKENS, bind: bool = True) -> DataFrame:
    """Token-null the date text, parse the first matching layout,
    add ``year, month, day`` and (by default) drop rows that did not parse. ``bind``: see ``parse_date``."""
    parsed = parse_date(date_col, formats, tokens, bind)
    df = df.withColumns({date_col: null_if_token(date_col, tokens), out: parsed})
    df = df.withColumns(calendar_parts(out))
    return df.filter(F.col(out).isNotNull()) if drop_unparsed else df


def clean_readings(df: DataFrame, drop_unparsed: bool = True) -> DataFrame:
    """rspm->pm10, location->city, concentrations -> double, dates parsed."""
    df = rename_columns(df, {**COLUMN_RENAMES, **ENTITY_RENAME})
    return parse_dates(cast_numeric(df), drop_unparsed=drop_unparsed)


def drop_missing(df: DataFrame, column: str = "AQI") -> DataFrame:
    """P7 (and P10): keep rows where ``column`` is not null."""
    return df.filter(F.col(column).isNotNull())


def select_existing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Project the requested columns that exist, in request order."""
    have = set(df.columns)
    return df.select(*[c for c in columns if c in have])
