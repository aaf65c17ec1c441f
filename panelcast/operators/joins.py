"""Joins in time that stay balanced when one key holds most rows.

``asof_join`` lays both sides on one timeline per key and carries the last known right row forward in two
levels: inside runs of ``chunk_rows`` consecutive rows, and over one row per run. ``interval_join`` turns
"point within interval" into an equi-join on bins whose width follows each interval's length.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, IntegralType, TimestampNTZType, TimestampType

from panelcast.operators.windows import DEFAULT_CHUNK_ROWS, sorted_runs, with_positions
from panelcast.panel import PanelSpec
from panelcast.session import staged


def asof_join(left: DataFrame, right: DataFrame, by: str, time: str, right_time: str | None = None,
              columns: Sequence[str] | None = None, ties: Sequence[str] = (), direction: str = "backward",
              exact: bool = True, prefix: str = "", chunk_rows: int = DEFAULT_CHUNK_ROWS, time_bucket: int | None = None) -> DataFrame:
    """Every left row once, with ``columns`` of the last right row of its key at or before its time
    (``direction="forward"``: the first at or after it). ``exact=False`` leaves equal times out.

    Of right rows at the same key and time the last by ``ties`` counts (forward: the first). Left rows whose key or
    time is null, or that have no right row, get nulls; right rows without key or time match nothing. The right columns are named
    ``prefix`` and their own name and replace left columns so named.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction is backward or forward")
    right_time = right_time or time
    columns = list(columns) if columns is not None else [c for c in right.columns if c not in (by, right_time)]
    names = [f"{prefix}{c}" for c in columns]
    kept = left.drop(*names)
    back = direction == "backward"
    # at one time: right rows first if they count for the left rows there and the last row is carried forward
    first = 0 if exact == back else 2
    tie = F.struct(*ties) if ties else F.lit(0)
    r = right.filter(F.col(by).isNotNull() & F.col(right_time).isNotNull()).select(
        F.col(by).alias("_k"), F.col(right_time).alias("_t"), F.lit(first).alias("_side"), tie.alias("_tie"),
        F.struct(F.lit(True).alias("there"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]).alias("_right"))
    whole = F.struct(*[F.col(f"`{c}`") for c in kept.columns])
    placed = kept.filter(F.col(by).isNotNull() & F.col(time).isNotNull())
    l = placed.select(F.col(by).alias("_k"), F.col(time).alias("_t"), F.lit(1).alias("_side"), whole.alias("_left"))  # noqa: E741
    merged = r.unionByName(l, allowMissingColumns=True)
    spec = PanelSpec("_k", "_t", ("_side", "_tie"), time_bucket=time_bucket)
    rows = with_positions(merged, spec, "_rn", chunk_rows=chunk_rows).withColumn("_run", F.floor(F.col("_rn") / chunk_rows))
    # one row per run: the right row it hands on, then the one it gets from the runs before (after)
    edge = F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col("_rn") if back else -F.col("_rn")))
    runs = rows.groupBy("_k", "_run").agg(edge.alias("_edge"))
    order = Window.partitionBy("_k").orderBy(F.col("_run").asc() if back else F.col("_run").desc())
    given = F.last("_edge", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("_k").alias("_k2"), F.col("_run").alias("_run2"), given.alias("_given"))
    inside = Window.partitionBy("_k", "_run").orderBy(F.col("_rn").asc() if back else F.col("_rn").desc())
    near = F.last("_right", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_near", near).filter("_left is not null")
    rows = rows.join(runs, (F.col("_k") == F.col("_k2")) & (F.col("_run") == F.col("_run2")))
    match = F.coalesce("_near", "_given")
    found = rows.select("_left", match.alias("_m")).select("_left.*", *[F.col(f"_m.c{i}").alias(n) for i, n in enumerate(names)])
    unplaced = kept.filter(F.col(by).isNull() | F.col(time).isNull())
    return found.unionByName(unplaced, allowMissingColumns=True)


def _ticks(col: Column, kind) -> Column:
    """Time as a whole number: microseconds, or days for dates, or the number itself."""
    if isinstance(kind, DateType):
        return F.datediff(col, F.lit("1970-01-01").cast("date")).cast("long")
    if isinstance(kind, TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col)
    if isinstance(kind, TimestampType):
        return F.unix_micros(col)
    return col.cast("long")


def interval_join(points: DataFrame, intervals: DataFrame, by: str, time: str, start: str, end: str,
                  suffix: str = "_interval", cell_rows: int = DEFAULT_CHUNK_ROWS,
                  totals: Mapping[str, str | None] | None = None) -> DataFrame:
    """All (point, interval) rows of equal key with ``start <= time < end``; every such pair once.

    An interval belongs to the level ``l`` with ``2**(l-1) < end - start <= 2**l`` (its own length sets the width of its bins) and lies in at
    most two bins of ``2**l``; a point asks each level that exists (at most 64) for the one bin it is in. So the join is on
    (key, level, bin), a pair meets in one bin only, and no interval is copied more than twice. Bins that more than
    ``cell_rows`` points ask are dealt by salts, with a copy of their intervals each. Null keys and times, and intervals that end at or
    before their start, match nothing. Interval columns whose names the points have get ``suffix``.

    With ``totals`` (name -> ``None`` for the number of pairs, or an integer or decimal column of the intervals for its sum)
    every point that has a pair comes once, with these totals over its pairs. As the pairs grow with the product of both sides, none is made
    then: the totals are running ones over points, starts and ends in order (``_interval_totals``).
    """
    if totals is not None:
        return _interval_totals(points, intervals, by, time, start, end, totals, cell_rows)
    kind = points.schema[time].dataType
    twice = [c for c in intervals.columns if c in points.columns]
    iv = intervals.select(*[F.col(f"`{c}`").alias(f"{c}{suffix}" if c in twice else c) for c in intervals.columns])
    named = {c: f"{c}{suffix}" if c in twice else c for c in (by, start, end)}
    iv = iv.withColumns({"_a": _ticks(F.col(named[start]), intervals.schema[start].dataType), "_b": _ticks(F.col(named[end]), intervals.schema[end].dataType)})
    iv = iv.filter(F.col(named[by]).isNotNull() & (F.col("_a") < F.col("_b")))
    # bits of length - 1: the power of two that the length does not exceed
    level = F.length(F.ltrim(F.bin(F.col("_b") - F.col("_a") - 1), F.lit("0")))
    iv = iv.withColumn("_level", level.cast("int"))
    levels = [r["_level"] for r in iv.select("_level").distinct().orderBy("_level").collect()]
    asked = points.filter(F.col(by).isNotNull() & F.col(time).isNotNull()).withColumn("_x", _ticks(F.col(time), kind))
    cells = ["_key", "_level", "_bin"]
    asked = asked.withColumn("_level", F.explode(F.array(*[F.lit(v).cast("int") for v in levels]) if levels else F.array().cast("array<int>")))
    asked = asked.withColumns({"_key": F.col(by), "_bin": F.expr("shiftright(_x, _level)")})
    held = iv.withColumns({"_key": F.col(named[by]), "_bin": F.explode(F.expr("sequence(shiftright(_a, _level), shiftright(_b - 1, _level))"))})
    full = asked.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > cell_rows)
    full = staged(full.withColumn("_salts", F.ceil(F.col("_n") / cell_rows).cast("int")).drop("_n"), "full-cells")
    if not full.isEmpty():
        salts = F.coalesce("_salts", F.lit(1))
        asked = asked.join(full, cells, "left").withColumn("_salt", F.pmod(F.xxhash64(*points.columns), salts).cast("int")).drop("_salts")
        held = held.join(full, cells, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
        cells = [*cells, "_salt"]
    met = asked.join(held, cells).filter((F.col("_a") <= F.col("_x")) & (F.col("_x") < F.col("_b")))
    return met.select(*[F.col(f"`{c}`") for c in points.columns], *[F.col(f"`{c}{suffix}`" if c in twice else f"`{c}`") for c in intervals.columns])


def _interval_totals(points: DataFrame, intervals: DataFrame, by: str, time: str, start: str, end: str,
                     totals: Mapping[str, str | None], run_rows: int) -> DataFrame:
    """An interval adds its values at its start and takes them away at its end; a point has what has been added up
    to its time. The running totals of a key go in two levels: within runs of ``run_rows`` rows, and over one row per run."""
    kinds = {c: intervals.schema[c].dataType for c in totals.values() if c is not None}
    if wrong := [c for c, k in kinds.items() if not isinstance(k, (IntegralType, DecimalType))]:
        raise TypeError(f"running totals of {', '.join(wrong)} would not be exact: integers or decimals only")
    wide = {c: f"decimal(38,{k.scale if isinstance(k, DecimalType) else 0})" for c, k in kinds.items()}
    # the number of pairs, and of each column the sum and the number of its values (a sum of nulls alone is null)
    parts = {"_n": F.lit(1).cast("long")}
    for i, c in enumerate(kinds):
        parts[f"_s{i}"], parts[f"_v{i}"] = F.coalesce(F.col(c).cast(wide[c]), F.lit(0).cast(wide[c])), F.col(c).isNotNull().cast("long")
    iv = intervals.select(F.col(by).alias("_k"), _ticks(F.col(start), intervals.schema[start].dataType).alias("_a"),
                          _ticks(F.col(end), intervals.schema[end].dataType).alias("_b"), *[e.alias(n) for n, e in parts.items()])
    iv = iv.filter(F.col("_k").isNotNull() & (F.col("_a") < F.col("_b")))
    steps = iv.select("_k", F.col("_a").alias("_x"), *parts).unionByName(iv.select("_k", F.col("_b").alias("_x"), *[(-F.col(n)).alias(n) for n in parts]))
    kept = {n: wide[list(kinds)[int(n[2:])]] if n.startswith("_s") else "long" for n in parts}
    steps = steps.groupBy("_k", "_x").agg(*[F.sum(n).cast(t).alias(n) for n, t in kept.items()]).withColumn("_side", F.lit(0))
    asked = points.filter(F.col(by).isNotNull() & F.col(time).isNotNull()).select(
        F.col(by).alias("_k"), _ticks(F.col(time), points.schema[time].dataType).alias("_x"), *[F.lit(0).cast(t).alias(n) for n, t in kept.items()],
        F.lit(1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_point"))
    # starts and ends of a time come before its points: start <= time < end
    line = sorted_runs(asked.unionByName(steps, allowMissingColumns=True), [F.col(c).asc() for c in ("_k", "_x", "_side")], run_rows, "_run")
    runs = line.groupBy("_k", "_run").agg(*[F.sum(n).cast(t).alias(n) for n, t in kept.items()])
    earlier = Window.partitionBy("_k").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("_k").alias("_k2"), F.col("_run").alias("_run2"),
                       *[F.coalesce(F.sum(n).over(earlier).cast(t), F.lit(0).cast(t)).alias(f"{n}_b") for n, t in kept.items()])
    upto = Window.partitionBy("_k", "_run").orderBy("_x", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.select("_k", "_run", "_point", *[F.sum(n).over(upto).cast(t).alias(n) for n, t in kept.items()]).filter("_point is not null")
    line = line.join(runs, (F.col("_k") == F.col("_k2")) & (F.col("_run") == F.col("_run2")))
    total = {n: F.col(n) + F.col(f"{n}_b") for n in kept}
    made = []
    for name, c in totals.items():
        i = list(kinds).index(c) if c is not None else None
        value = total["_n"] if i is None else F.when(total[f"_v{i}"] > 0, total[f"_s{i}"].cast("long" if wide[c].endswith(",0)") and isinstance(kinds[c], IntegralType) else wide[c]))
        made.append(value.alias(name))
    return line.filter(total["_n"] > 0).select("_point.*", *made)
