"""Exact discrete quantiles by distributed selection, one plan for every size.

The value of rank ``k = ceil(p * n)`` (the discrete quantile of Spark and DuckDB)
is found by narrowing an interval known to hold it:

1. One aggregate gives the number of values and their finite minimum and maximum.
2. A pass counts the interval's rows in ``bins`` equal parts — an aggregate over
   (target, bin), combined map-side — and keeps the (min, max) found in the bin
   that holds the rank. It ends when that bin holds one distinct value.

Every pass separates the interval's minimum from its maximum, so it always gets
smaller and the loop needs no limit. No task sorts or merges more than the bins.
Nulls and NaN are left out; infinities are the lowest and highest values and are
only counted. Values keep their type: dates, timestamps, integers and decimals are
compared exactly, in no step as doubles.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    TimestampNTZType,
    TimestampType,
)

from panelcast.session import checkpoint_dir

BINS = 4_096
GROUP_BINS = 512
#: Open intervals up to which every task of a pass over groups is given all of them.
BROADCAST_INTERVALS = 100_000
#: Values from which a group's intervals are given to every task however many groups there are.
HOT_ROWS = 1_000_000
_DAY0, _TIME0 = dt.date(1970, 1, 1), dt.datetime(1970, 1, 1)


def _ordered(col: Column, kind: DataType) -> Column:
    """The column as an exact ordered number: a long (days, microseconds, integers),
    a decimal or a double (NaN as null)."""
    if isinstance(kind, DateType):
        return F.datediff(col, F.lit(_DAY0)).cast("long")
    if isinstance(kind, TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit(_TIME0).cast("timestamp_ntz"), col)
    if isinstance(kind, (DoubleType, FloatType)):
        return F.nanvl(col.cast("double"), F.lit(None).cast("double"))
    return col if isinstance(kind, DecimalType) else col.cast("long")


def _restored(value: Column, kind: DataType) -> Column:
    """Back from ``_ordered`` to the column's type."""
    if isinstance(kind, DateType):
        return F.date_add(F.lit(_DAY0), value.cast("int"))
    if isinstance(kind, TimestampType):
        return F.timestamp_micros(value)
    if isinstance(kind, TimestampNTZType):
        return F.timestamp_add("MICROSECOND", value, F.lit(_TIME0).cast("timestamp_ntz"))
    return value.cast(kind)


def _is_real(kind: DataType) -> bool:
    return isinstance(kind, (DoubleType, FloatType))


def _bin(x: Column, lo: Column, hi: Column, kind: DataType, bins: int) -> Column:
    """Which of ``bins`` equal parts of [lo, hi] holds x; lo in the first, hi in the last."""
    if _is_real(kind):  # halves, so that the width of the widest interval is finite
        part = (x / 2 - lo / 2) / (hi / 2 - lo / 2)
    else:
        wide = f"decimal(38,{kind.scale})" if isinstance(kind, DecimalType) else "decimal(38,0)"
        part = (x.cast(wide) - lo.cast(wide)).cast("double") / (hi.cast(wide) - lo.cast(wide)).cast("double")
    # nearby values may round to one part; the ends never share a bin
    b = F.least(F.floor(part * bins), F.lit(bins - 1))
    return F.when(x == lo, 0).when(x == hi, bins - 1).otherwise(b).cast("int")


def _infinite(x: Column, kind: DataType, sign: str) -> Column:
    return x == F.lit(float(f"{sign}inf")) if _is_real(kind) else F.lit(False) & x.isNotNull()


def _summary(x: Column, kind: DataType) -> list[Column]:
    """Count of values, of -inf, of +inf, and the finite ends."""
    low, high = _infinite(x, kind, "-"), _infinite(x, kind, "+")
    finite = F.when(~low & ~high, x)
    return [F.count(x), F.count(F.when(low, 1)), F.count(F.when(high, 1)), F.min(finite), F.max(finite)]


def _whole_range(data: DataFrame, columns: Sequence[str], probs: Sequence[float], kinds: dict, name: dict, settled: dict) -> dict:
    """Per (column, place of the prob): rank, finite ends, values below; infinite quantiles go to ``settled``."""
    row = data.agg(*[e.alias(f"{name[c]}_{i}") for c in columns for i, e in enumerate(_summary(F.col(name[c]), kinds[c]))]).first()
    start = {}
    for c in columns:
        n, low, high, lo, hi = (row[f"{name[c]}_{i}"] for i in range(5))
        for j, p in enumerate(probs):
            k = min(max(math.ceil(p * n), 1), n) if n else 0
            if n and (k <= low or k > n - high):
                settled[c, j] = -math.inf if k <= low else math.inf
            start[c, j] = (k, lo, hi, low) if n else None
    return start


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], bins: int = BINS,
                    start: dict[tuple[str, int], tuple | None] | None = None) -> dict[str, list]:
    """``{column: [value per prob]}`` in the columns' own types; ``None`` for a column with no values.

    ``start`` gives what is known of each (column, place of the prob) — rank, least and largest value that
    occur around it, number of values below — or ``None`` without values; the first aggregate is then left out."""
    kinds = {c: df.schema[c].dataType for c in columns}
    name = {c: f"_q{i}" for i, c in enumerate(columns)}
    data = df.select(*[_ordered(F.col(c), kinds[c]).alias(name[c]) for c in columns])
    settled, todo = {}, {}  # todo: (column, prob index) -> [rank wanted, lo, hi, rows below lo]
    if start is None:
        start = _whole_range(data, columns, probs, kinds, name, settled)
    for target, known in start.items():
        if target in settled:
            continue
        if known is None or known[1] == known[2]:
            settled[target] = None if known is None else known[1]
        else:
            todo[target] = list(known)
    while todo:
        ids = list(todo)
        cells = []
        for i, (c, j) in enumerate(ids):
            _, lo, hi, _ = todo[c, j]
            x, a, b = F.col(name[c]), _typed(lo, data, name[c]), _typed(hi, data, name[c])
            cells.append(F.when((x >= a) & (x <= b), F.struct(F.lit(i).alias("t"), _bin(x, a, b, kinds[c], bins).alias("b"))))
        rows = data.select("*", F.explode(F.array(*cells)).alias("_cell")).filter("_cell is not null")
        # the value that belongs to a target is one of the columns
        used = dict.fromkeys(c for c, _ in ids)
        ends = [f(F.col(name[c])).alias(f"{n}{name[c]}") for c in used for n, f in (("mn", F.min), ("mx", F.max))]
        hist = rows.groupBy("_cell.t", "_cell.b").agg(F.count(F.lit(1)).alias("cnt"), *ends).collect()  # at most targets * bins rows
        by_target: dict[int, list] = {}
        for r in sorted(hist, key=lambda r: (r["t"], r["b"])):
            by_target.setdefault(r["t"], []).append(r)
        for i, (c, j) in enumerate(ids):
            k, _, _, below = todo[c, j]
            for r in by_target[i]:
                if below + r["cnt"] >= k:
                    break
                below += r["cnt"]
            if r[f"mn{name[c]}"] == r[f"mx{name[c]}"]:
                settled[c, j] = r[f"mn{name[c]}"]
                del todo[c, j]
            else:
                todo[c, j] = [k, r[f"mn{name[c]}"], r[f"mx{name[c]}"], below]
    return {c: _python_values(df, [settled[c, j] for j in range(len(probs))], kinds[c]) for c in columns}


def _typed(value, data: DataFrame, column: str) -> Column:
    return F.lit(value).cast(data.schema[column].dataType)


def _python_values(df: DataFrame, values: list, kind: DataType) -> list:
    """Values of ``_ordered`` as Python objects of the column's type."""
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        row = df.sparkSession.range(1).select(*[_restored(F.lit(v).cast("long"), kind).alias(f"v{i}") for i, v in enumerate(values)]).first()
        return list(row)
    return values


def _with_intervals(base: DataFrame, iv: DataFrame, few: bool) -> DataFrame:
    """The rows with each interval of their group."""
    same = F.col("_g").eqNullSafe(F.col("_h"))
    if few:
        return base.join(F.broadcast(iv), same)
    hot = iv.filter("_hot")  # at most a group a HOT_ROWS values
    cold = base.join(F.broadcast(hot.select("_h").distinct()), same, "left_anti")
    return base.join(F.broadcast(hot), same).unionByName(cold.join(iv.filter(~F.col("_hot")), same))


def exact_group_quantiles(df: DataFrame, group: str, column: str, probs: Sequence[float],
                          bins: int = GROUP_BINS) -> DataFrame:
    """Per-group exact discrete quantiles: rows ``(group, prob_idx, value)``.

    All groups narrow their intervals together: a pass gives the rows their
    group's interval and counts (group, prob, bin), spread over reducers however big a
    group is. Up to ``BROADCAST_INTERVALS`` intervals go to every task, so no rows move; beyond that only those
    of groups over ``HOT_ROWS`` values do, and the rest are joined on the group; a window over at most ``bins`` rows per (group, prob) picks the bin of
    the rank. A null group is a group; groups without values give no rows.
    """
    checkpoint_dir(df.sparkSession)
    kind = df.schema[column].dataType
    base = df.select(F.col(group).alias("_g"), _ordered(F.col(column), kind).alias("_x")).filter("_x is not null")
    names = ["_n", "_low", "_high", "_lo", "_hi"]
    stats = base.groupBy("_g").agg(*[e.alias(n) for n, e in zip(names, _summary(F.col("_x"), kind))])
    pairs = F.array(*[F.struct(F.lit(j).alias("_j"), F.lit(float(p)).alias("_p")) for j, p in enumerate(probs)])
    rank = F.least(F.greatest(F.ceil(F.col("_p") * F.col("_n")), F.lit(1)), F.col("_n")).cast("long")
    state = stats.select("*", F.explode(pairs).alias("_q")).select("*", "_q.*").withColumn("_k", rank)
    known = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
    if _is_real(kind):
        known = (F.when(F.col("_k") <= F.col("_low"), F.lit(-math.inf))
                 .when(F.col("_k") > F.col("_n") - F.col("_high"), F.lit(math.inf)).otherwise(known))
    state = state.select("_g", "_j", "_k", "_lo", "_hi", F.col("_low").alias("_below"), known.alias("_v"), (F.col("_n") > HOT_ROWS).alias("_hot"))
    done = []
    while True:
        state = state.checkpoint()
        done.append(state.filter("_v is not null").select("_g", "_j", "_v"))
        open_ = state.filter("_v is null")
        n_open = open_.count()
        if not n_open:
            break
        iv = open_.select(F.col("_g").alias("_h"), "_j", "_k", "_lo", "_hi", "_below", "_hot")
        met = _with_intervals(base, iv, n_open <= BROADCAST_INTERVALS).filter(F.col("_x").between(F.col("_lo"), F.col("_hi")))
        b = _bin(F.col("_x"), F.col("_lo"), F.col("_hi"), kind, bins)
        hist = (met.groupBy("_g", "_j", "_k", "_below", "_hot", b.alias("_b"))
                .agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_mn"), F.max("_x").alias("_mx")))
        upto = F.sum("_c").over(Window.partitionBy("_g", "_j").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        hist = hist.withColumn("_end", F.col("_below") + upto)
        hit = hist.filter((F.col("_end") >= F.col("_k")) & (F.col("_end") - F.col("_c") < F.col("_k")))
        state = hit.select("_g", "_j", "_k", F.col("_mn").alias("_lo"), F.col("_mx").alias("_hi"),
                           (F.col("_end") - F.col("_c")).alias("_below"),
                           F.when(F.col("_mn") == F.col("_mx"), F.col("_mn")).alias("_v"), "_hot")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(F.col("_g").alias(group), F.col("_j").alias("prob_idx"), _restored(F.col("_v"), kind).alias("value"))
