"""K-d tree sharding with DataFrame functions only.

Documents become points of metadata dimensions. A node that stands for several
shards is split across its widest dimension at the weighted median (with an odd
number of shards, at the weighted quantile that gives both sides their part),
weights being bytes, until every leaf is one shard. All nodes of a level split at once.

The median is found by distributed selection: coordinates are integers with a
hash of the row below them (so a third of all rows at one coordinate still
splits), and a pass sums bytes per (node, next digit), keeping one digit a node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from panelcast.llm.scratch import stored

SHARDS = 24
#: Bits of a coordinate, of the hash below it and of one selection pass.
VALUE_BITS, TIE_BITS, DIGIT_BITS = 24, 24, 12
#: A node's cut may miss its weighted median by this part of one shard's bytes.
TOLERANCE = 1e-4
SLOT_ROWS = 5_000


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _coordinates(docs: DataFrame, dims: Sequence[str], sized: DataFrame) -> DataFrame:
    """Columns d0, d1, ...: every dimension as an integer of VALUE_BITS, order kept.
    Numbers are scaled by their range, texts stand by their first three UTF-8 bytes; nulls and NaN are lowest."""
    top = 2**VALUE_BITS - 1
    kinds = {k: sized.schema[f"_{k}"].dataType for k in range(len(dims))}
    numeric = [k for k, t in kinds.items() if isinstance(t, NumericType)]
    value = {k: F.nanvl(F.col(f"_{k}").cast("double"), F.lit(None).cast("double")) for k in numeric}
    ends = sized.agg(F.lit(0), *[f(value[k]).alias(f"{n}{k}") for k in numeric for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = sized
    for k in range(len(dims)):
        if k in numeric:
            lo, hi = ends[f"lo{k}"], ends[f"hi{k}"]
            if lo is None or not hi > lo:
                c = F.lit(0)
            else:
                c = F.coalesce(F.floor((value[k] - lo) / F.lit(float(hi) - float(lo)) * top), F.lit(0))
        else:
            head = F.rpad(F.hex(F.substring(F.coalesce(F.col(f"_{k}"), F.lit("")).cast("binary"), 1, 3)), 6, "0")
            c = F.conv(head, 16, 10)
        out = out.withColumn(f"d{k}", c.cast("long"))
    return out.drop(*[f"_{k}" for k in range(len(dims))])


def kd_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS,
              dims: Sequence[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``law`` is ``bytes``: shard sizes are near equal, each cut within TOLERANCE of
    a shard or one document. ``dims`` are metadata columns (numbers or texts; by default
    those of the text's size, ``source``, ``lang`` and ``doc_id`` that exist). ``slot`` counts
    a shard's rows gaplessly from 0. ``grown_shard`` is null: a further shard moves cuts.
    Null texts have size 8 and crc 0, null ids and repeated rows are rows like
    others, equal points are split by hash, an empty table gives no rows;
    columns not named are not read.
    """
    if dims is None:
        dims = [c for c in ("source", "lang", "doc_id") if c in docs.columns]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kinds = (NumericType, StringType)
    picked = [byte_size(F.col(text))] + [F.col(c) if isinstance(docs.schema[c].dataType, kinds) else F.col(c).cast("string") for c in dims]
    sized = docs.select(F.col(doc_id).alias("doc_id"), byte_size(F.col(text)).alias("size"),
                        F.crc32(body.cast("binary")).alias("text_crc32"),
                        *[c.alias(f"_{k}") for k, c in enumerate(picked)])
    sized = stored(sized, "kd-metadata")
    rows = _coordinates(docs, picked, sized)
    tie = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(2**TIE_BITS))
    rows = stored(rows.withColumn("tie", tie), "kd-points")
    return _slots(_shard_of(rows, len(picked), shards), shards)


def _shard_of(rows: DataFrame, n_dims: int, shards: int) -> DataFrame:
    """``rows`` with ``shard``. A node is named by its first shard, so a split keeps
    the left part's name. Only node spans and cuts (a row per node) reach the driver."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = TOLERANCE * total / max(shards, 1)
    rows, open_ = rows.withColumn("shard", F.lit(0).cast("int")), {0: shards}
    while any(n > 1 for n in open_.values()):
        todo = {k: n for k, n in open_.items() if n > 1}
        named = rows.filter(F.col("shard").isin(list(todo)))
        spans = {r["shard"]: r for r in named.groupBy("shard").agg(
            F.sum("size").alias("bytes"), *[f(f"d{k}").alias(f"{n}{k}") for k in range(n_dims)
                                            for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        widest = [0] * shards
        for k, r in spans.items():
            widest[k] = max(range(n_dims), key=lambda d: (r[f"hi{d}"] - r[f"lo{d}"], -d))
        dim = F.get(F.array(*[F.lit(w) for w in widest]), F.col("shard"))
        key = F.shiftleft(F.get(F.array(*[F.col(f"d{k}") for k in range(n_dims)]), dim), TIE_BITS) + F.col("tie")
        want = {k: r["bytes"] * (todo[k] // 2) / todo[k] for k, r in spans.items()}
        cuts = _weighted_quantiles(named.select("shard", key.alias("key"), "size"), want, slack)
        # rows above their node's cut go to its right part; nodes that are leaves have no cut
        cut = F.get(F.array(*[F.lit(cuts.get(k, 2**62)) for k in range(shards)]), F.col("shard"))
        step = F.get(F.array(*[F.lit(todo.get(k, 0) // 2) for k in range(shards)]), F.col("shard"))
        moved = F.when(key > cut, F.col("shard") + step).otherwise(F.col("shard"))
        rows = stored(rows.withColumn("shard", moved), "kd-level")  # else the next level's plan nests this one's
        open_ = {j: m for k, n in open_.items()
                 for j, m in ([(k, n // 2), (k + n // 2, n - n // 2)] if n > 1 else [(k, n)])}
    return rows


def _weighted_quantiles(keyed: DataFrame, want: dict[int, float], slack: float) -> dict[int, int]:
    """Per node the key up to which its rows hold about ``want`` bytes: digit by digit
    from the top, summing bytes per (node, digit) of the rows that share the digits so far."""
    bits = VALUE_BITS + TIE_BITS
    prefix, below = {k: 0 for k in want}, {k: 0 for k in want}
    cuts: dict[int, int] = {}
    spark = keyed.sparkSession
    while len(cuts) < len(want):
        bits -= DIGIT_BITS
        going = [k for k in want if k not in cuts]
        known = spark.createDataFrame([(k, prefix[k], float(want[k] - below[k])) for k in going], "_node int, _prefix long, _need double")
        digit = F.shiftright(F.col("key"), bits)
        sums = (keyed.join(F.broadcast(known), (F.col("shard") == F.col("_node"))
                           & (F.shiftright(F.col("key"), bits + DIGIT_BITS) == F.col("_prefix")))
                .groupBy("shard", "_need", digit.alias("digit")).agg(F.sum("size").alias("bytes")))
        upto = F.sum("bytes").over(Window.partitionBy("shard").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        # the digit in which the wanted bytes are reached
        met = (sums.withColumn("upto", upto).filter("upto >= _need").groupBy("shard")
               .agg(F.min_by(F.struct("digit", "bytes", "upto"), "digit").alias("at")).collect())
        for r in met:
            k, at = r["shard"], r["at"]
            need = want[k] - below[k]
            start = at["upto"] - at["bytes"]
            if bits == 0 or at["bytes"] <= slack:
                # the nearer end of the digit's range
                before = need - start < at["upto"] - need
                cuts[k] = (at["digit"] << bits) - 1 if before else ((at["digit"] + 1) << bits) - 1
            else:
                prefix[k], below[k] = at["digit"], below[k] + start
        for k in going:
            if k not in {r["shard"] for r in met}:  # a node without rows
                cuts[k] = 0
    return cuts


def _slots(rows: DataFrame, shards: int) -> DataFrame:
    """Number every shard's rows from 0 without ordering a shard in one task: rows are
    ordered within hash buckets, and prefix sums of bucket counts start each bucket."""
    n = rows.count()
    per_shard = max(1, -(-n // (max(shards, 1) * SLOT_ROWS)))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(per_shard)).cast("int"))
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = (counts.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
              .select(F.col("shard").alias("_s"), F.col("_bucket").alias("_b"), "_base"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("_r", F.row_number().over(inside))
    joined = numbered.join(counts, (F.col("shard") == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return joined.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                         (F.col("_base") + F.col("_r") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
