"""Null-token normalisation and safe numeric casts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings treated as missing after trim + upper-case.
NULL_TOKENS = ("", "NA", "NONE")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_token(c: str | Column, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """``null`` when ``upper(trim(c))`` is one of ``tokens``, else ``c``."""
    col = _col(c)
    return F.when(F.upper(F.trim(col)).isin(*tokens), F.lit(None)).otherwise(col)


def clean_double(c: str | Column, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """Token-null then ``try_cast`` to double: junk becomes null instead of
    raising ``CAST_INVALID_INPUT`` under ANSI mode. Text of NaN or of an infinite
    value (``inf``, ``1e400``) is no reading either and becomes null."""
    value = null_if_token(c, tokens).try_cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)
