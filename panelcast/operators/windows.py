"""Row-ordered panel windows that stay balanced when one entity is huge.

Every feature in this library (lead target, lags, rolling means, sequence
windows) is a *bounded* row frame: it looks at most ``lookback`` rows back
and ``lookahead`` rows ahead inside one entity. A plain
``Window.partitionBy(entity)`` hashes each entity into a single task, so an
entity holding a third of all rows would be sorted and scanned by one task.

``strategy="chunked"`` splits every entity into runs of ``chunk_rows``
consecutive rows and gives each run a halo:

1. Rows are counted per entity (map-side combine). An entity of at most
   ``DEFAULT_CHUNK_ROWS`` rows (or a chunk, if that is more) is ranked by one
   ``row_number``; where no entity exceeds a chunk the whole panel is a plain window.
2. For larger entities the counts per (entity, day) and a running sum over the
   days give each day's starting offset within its entity, and a ``row_number`` within
   (entity, day) completes the exact 0-based position ``rn`` of each row in
   its entity, in (time, tie-breakers) order. Days of more rows than the unit are
   sorted by ranges first and cut into runs of half a unit (``position_cells``).
3. ``chunk = rn div chunk_rows``. A row is also copied, as halo, into the next
   chunk when it is among the last ``lookback`` rows of its chunk, and into
   the previous chunk when it is among the first ``lookahead`` rows.
4. The window runs over (entity, chunk) ordered by ``rn``; halo copies are
   then dropped. Each window partition holds at most
   ``chunk_rows + lookback + lookahead`` rows. For entities ranked whole it
   needs no further exchange, as their rows are already together.

``strategy="auto"`` is the chunked plan, whatever the size; ``"plain"`` is the single-shuffle
plan for panels whose entities are known to be even. Only rows that agree in the
entity and all order columns can't be parted (a ``PanelSpec`` promises there are none).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DateType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from panelcast.panel import PanelSpec
from panelcast.session import staged

WindowColumn = Callable[[WindowSpec], Column]

DEFAULT_CHUNK_ROWS = 200_000
STRATEGIES = ("auto", "plain", "chunked")

_RN, _CHUNK, _SHIFT = "_pc_rn", "_pc_chunk", "_pc_shift"
_BUCKET, _OFF, _N = "_pc_bucket", "_pc_off", "_pc_n"


def choose_strategy(strategy: str) -> str:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    return "chunked" if strategy == "auto" else strategy


def _non_null_key(col: Column, dtype) -> Column | None:
    """A never-null stand-in for ``col`` of the same type (paired with an
    ``isnull`` flag it groups exactly like ``col``), or ``None`` if the type
    has no natural default."""
    if isinstance(dtype, StringType):
        default = F.lit("")
    elif isinstance(dtype, DateType):
        default = F.lit(dt.date(1970, 1, 1))
    elif isinstance(dtype, (TimestampType, TimestampNTZType)):
        default = F.lit(dt.datetime(1970, 1, 1)).cast(dtype)
    elif isinstance(dtype, BooleanType):
        default = F.lit(False)
    elif isinstance(dtype, NumericType):
        default = F.lit(0).cast(dtype)
    else:
        return None
    return F.coalesce(col, default)


#: Sampled rows that stand for a chunk when a day is looked for that exceeds it.
CHUNK_SAMPLES = 64


def big_days(keyed: DataFrame, spec: PanelSpec, keys: list[str], chunk_rows: int) -> DataFrame:
    """The keys of each day of more than about a chunk of rows.

    The rows counted are chosen by a hash of their entity and order columns, so every reading of the input gives
    the same days.
    """
    step = max(1, chunk_rows // CHUNK_SAMPLES)
    half = max(1, chunk_rows // step // 2)
    sampled = keyed.filter(F.pmod(F.xxhash64(spec.entity, *spec.order_cols), F.lit(step)) == 0)
    return sampled.groupBy(*keys).agg(F.count(F.lit(1)).alias("_pc_seen")).filter(F.col("_pc_seen") > 2 * half).select(*keys)


def range_of(key: Column, cuts: Column) -> Column:
    """How many of the ascending cuts are at most ``key``, by halving."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(cuts) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        above = (s["lo"] < s["hi"]) & (F.get(cuts, mid) <= key)
        return F.struct(F.when(above, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(above | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(steps, start, halve)["lo"]


def sorted_runs(df: DataFrame, order: list[Column], run_rows: int, out: str) -> DataFrame:
    """The rows sorted by ranges of ``order`` and staged, with ``out``: the number of their run of at most ``run_rows``
    consecutive rows. Later runs have higher numbers; no task holds more than a range."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(out, F.monotonically_increasing_id())
    placed = staged(placed, "sorted-runs")
    # the id holds the range and, in its lower 33 bits, the place within it
    place = F.col(out).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(out, (F.col(out) - place + F.floor(place / F.lit(max(1, run_rows)))).cast("long"))


def position_cells(df: DataFrame, spec: PanelSpec, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> tuple[DataFrame, list[str]]:
    """The rows with the key columns of the smallest unit that is counted and ranked as a whole:
    (entity, day), and a run of the day where a day exceeds a chunk. Looking for such days is the one
    small job a window builder starts (a scan of the entity and order columns of a sample); their rows are
    sorted by ranges of the order columns and staged, so that no task holds a day, and a run is
    half a chunk of consecutive rows of one range.

    Entity and day are replaced by never-null key columns plus null flags, so that joins on them are
    plain equi-joins.
    """
    keyed = df.withColumn(_BUCKET, spec.bucket_expr(df))
    ke = _non_null_key(F.col(spec.entity), keyed.schema[spec.entity].dataType)
    kb = _non_null_key(F.col(_BUCKET), keyed.schema[_BUCKET].dataType)
    if ke is None or kb is None:
        raise TypeError(f"unsupported entity/time type for chunked windows: {spec.entity}, {spec.time}")
    keys = ["_pc_ke", "_pc_ne", "_pc_kb", "_pc_nb"]
    keyed = keyed.withColumns({"_pc_ke": ke, "_pc_ne": F.col(spec.entity).isNull(),
                               "_pc_kb": kb, "_pc_nb": F.col(_BUCKET).isNull()})
    big = staged(big_days(keyed, spec, keys, chunk_rows), "big-days")
    if big.isEmpty():
        return keyed.withColumn("_pc_part", F.lit(0).cast("long")), keys
    order = [*[F.col(k).asc() for k in keys], *spec.order_exprs()]
    cut = sorted_runs(keyed.join(big, keys, "left_semi"), order, chunk_rows // 2, "_pc_part")
    calm = keyed.join(big, keys, "left_anti").withColumn("_pc_part", F.lit(0).cast("long"))
    # one column that stands for the cell: rows dealt by the day alone (for the joins above) are dealt anew by it
    return calm.unionByName(cut).withColumn("_pc_cell", F.struct(*keys, "_pc_part")), ["_pc_cell"]


def with_positions(df: DataFrame, spec: PanelSpec, rn_col: str = _RN,
                   size_col: str | None = None, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Exact 0-based position of each row within its entity (and the entity size),
    without gathering an entity or a day into one task (steps 1-2 above). When the count
    table is too big to broadcast, the join's hash exchange on the cell also serves the
    ``row_number`` window — one exchange of the data, not two.
    """
    keyed, cell = position_cells(df, spec, chunk_rows)
    keys = ["_pc_ke", "_pc_ne", "_pc_kb", "_pc_nb"]
    per_entity = Window.partitionBy("_pc_ke", "_pc_ne")
    day_order = per_entity.orderBy(F.col("_pc_nb").desc(), F.col("_pc_kb").asc(), F.col("_pc_part").asc())  # null day first
    counts = keyed.groupBy(*keys, "_pc_part", *[c for c in cell if c not in keys]).agg(F.count(F.lit(1)).alias("_pc_cnt"))
    counts = counts.select(
        *cell,
        F.coalesce(F.sum("_pc_cnt").over(day_order.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias(_OFF),
        F.sum("_pc_cnt").over(per_entity).alias(_N))
    joined = keyed.join(counts, on=cell, how="inner")
    within_cell = Window.partitionBy(*cell).orderBy(*spec.order_exprs())
    out = joined.withColumn(rn_col, F.col(_OFF) + F.row_number().over(within_cell) - 1)
    if size_col:
        out = out.withColumn(size_col, F.col(_N))
    return out.drop(*keys, "_pc_part", "_pc_cell", _BUCKET, _OFF, _N)


def _plain(df: DataFrame, spec: PanelSpec, columns: Mapping[str, WindowColumn],
           rn_col: str | None, size_col: str | None) -> DataFrame:
    w = spec.window()
    exprs = {name: fn(w) for name, fn in columns.items()}
    if rn_col:
        exprs[rn_col] = F.row_number().over(w) - 1
    if size_col:
        exprs[size_col] = F.count(F.lit(1)).over(Window.partitionBy(spec.entity))
    return df.withColumns(exprs)


def _in_chunks(pos: DataFrame, spec: PanelSpec, columns: Mapping[str, WindowColumn],
               lookback: int, lookahead: int, chunk_rows: int) -> DataFrame:
    """Steps 3 and 4 on rows that have their position."""
    chunk = F.floor(F.col(_RN) / F.lit(chunk_rows)).cast("long")
    offset = F.col(_RN) - chunk * F.lit(chunk_rows)
    shifts = [F.lit(0)]
    if lookback > 0:  # tail rows also serve the next chunk's look-back
        shifts.append(F.when(offset >= chunk_rows - lookback, F.lit(1)))
    if lookahead > 0:  # head rows also serve the previous chunk's look-ahead
        shifts.append(F.when((offset < lookahead) & (chunk > 0), F.lit(-1)))
    copies = (pos.withColumn(_SHIFT, F.explode(F.array(*shifts)))
              .filter(F.col(_SHIFT).isNotNull())
              .withColumn(_CHUNK, chunk + F.col(_SHIFT)))
    w = Window.partitionBy(spec.entity, _CHUNK).orderBy(F.col(_RN))
    out = copies.withColumns({name: fn(w) for name, fn in columns.items()})
    return out.filter(F.col(_SHIFT) == 0).drop(_SHIFT, _CHUNK)


def _chunked(df: DataFrame, spec: PanelSpec, columns: Mapping[str, WindowColumn],
             lookback: int, lookahead: int, chunk_rows: int,
             rn_col: str | None, size_col: str | None) -> DataFrame:
    if chunk_rows < max(lookback, lookahead, 1):
        raise ValueError("chunk_rows must be at least max(lookback, lookahead, 1)")
    spec.bucket_expr(df)  # raises for a time without bounded buckets, whatever the sizes
    unit = max(chunk_rows, DEFAULT_CHUNK_ROWS)
    sizes = df.groupBy(F.col(spec.entity).alias("_pc_big")).agg(F.count(F.lit(1)).alias("_pc_n")).filter(F.col("_pc_n") > chunk_rows)
    sizes = staged(sizes, "large-entities")
    if sizes.isEmpty():
        out = _plain(df, spec, columns, rn_col, size_col)
        return out.withColumn(rn_col, F.col(rn_col).cast("long")) if rn_col else out
    size_tmp = size_col or "_pc_size"
    same = F.col(spec.entity).eqNullSafe(F.col("_pc_big"))
    large = sizes.filter(F.col("_pc_n") > unit)
    some = not large.isEmpty()
    whole = df.join(large, same, "left_anti") if some else df
    pos = whole.withColumn(_RN, (F.row_number().over(spec.window()) - 1).cast("long"))
    if size_col:
        pos = pos.withColumn(size_tmp, F.count(F.lit(1)).over(Window.partitionBy(spec.entity)))
    out = _in_chunks(pos, spec, columns, lookback, lookahead, chunk_rows)
    if some:
        pos = with_positions(df.join(large, same, "left_semi"), spec, _RN, size_tmp, unit)
        pos = pos.withColumn(_RN, F.col(_RN).cast("long"))
        if not size_col:
            pos = pos.drop(size_tmp)
        out = out.unionByName(_in_chunks(pos, spec, columns, lookback, lookahead, chunk_rows))
    if rn_col and rn_col != _RN:
        out = out.withColumnRenamed(_RN, rn_col)
    elif not rn_col:
        out = out.drop(_RN)
    return out


def add_window_columns(df: DataFrame, spec: PanelSpec, columns: Mapping[str, WindowColumn],
                       lookback: int, lookahead: int = 0, strategy: str = "auto",
                       chunk_rows: int = DEFAULT_CHUNK_ROWS, rn_col: str | None = None,
                       size_col: str | None = None) -> DataFrame:
    """Add bounded-frame window columns over the panel.

    ``columns`` maps output names to ``lambda w: <expr>.over(w)`` builders. The
    frames they use must stay within ``lookback`` rows back and ``lookahead``
    rows ahead (``lag(k)`` needs ``k <= lookback``, ``lead(h)`` needs
    ``h <= lookahead``, ``rowsBetween(-a, b)`` needs ``a <= lookback`` and
    ``b <= lookahead``); unbounded frames are not allowed. ``rn_col`` /
    ``size_col`` optionally expose each row's 0-based position and its entity's size.
    """
    mode = choose_strategy(strategy)
    if mode == "plain":
        return _plain(df, spec, columns, rn_col, size_col)
    return _chunked(df, spec, columns, lookback, lookahead, chunk_rows, rn_col, size_col)
