"""Multi-format date parsing (F4) and calendar parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelcast.functions.tokens import NULL_TOKENS, null_if_token

# Accepted date layouts, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "dd-MM-yyyy", "MM/dd/yyyy", "yyyy/MM/dd")


def _shape_guard(col: Column, fmt: str) -> Column | None:
    """Cheap test on where the first separator sits; ``None`` if the layout
    has no separator. A failed parse inside ``try_to_date`` costs an
    exception per row, so each row is first sent to the one layout whose
    shape it has."""
    seps = [i for i, ch in enumerate(fmt) if not ch.isalpha()]
    if not seps:
        return None
    pos, sep = seps[0] + 1, fmt[seps[0]]
    first_field = fmt[:seps[0]]
    at = F.instr(col, sep)
    # a year field may be wider than its pattern; day/month fields are fixed width
    return at >= pos if first_field.startswith("y") else at == pos


def _bind(col: Column, fn) -> Column:
    """Evaluate ``col`` once and hand it to ``fn`` as a lambda variable.

    Filters on the parsed date are pushed below the projection that defines
    it, and every reference to the input is then inlined; binding keeps the
    input (often itself an expression) from being recomputed per reference.
    """
    return F.element_at(F.transform(F.array(col), fn), 1)


def _parser(formats: Sequence[str]):
    def parse(s: Column) -> Column:
        fast = []
        for f in formats:
            guard = _shape_guard(s, f)
            fast.append(F.try_to_date(s, f) if guard is None else F.when(guard, F.try_to_date(s, f)))
        full = [F.try_to_date(s, f) for f in formats]
        return F.coalesce(*fast, *full)
    return parse


def _cleaner(formats: Sequence[str], tokens: Sequence[str]):
    def clean(x: Column) -> Column:
        return _bind(null_if_token(x, tokens), _parser(formats))
    return clean


def parse_date(c: str | Column, formats: Sequence[str] = DATE_FORMATS,
               tokens: Sequence[str] = NULL_TOKENS, bind: bool = True) -> Column:
    """First format that parses wins; unparseable text gives null (never raises).

    Rows go through the shape-guarded fast path first; whatever it leaves
    null is parsed by the plain ordered chain, so the result equals trying
    every format in order. ``bind=False`` parses without lambdas, under whole-stage codegen, for
    rows that are written before anything filters them.
    """
    col = F.col(c) if isinstance(c, str) else c
    if not bind:
        return _parser(tuple(formats))(null_if_token(col.cast("string"), tuple(tokens)))
    return _bind(col.cast("string"), _cleaner(tuple(formats), tuple(tokens)))


def calendar_parts(date_col: str = "date_parsed") -> dict[str, Column]:
    d = F.col(date_col)
    return {"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d)}
