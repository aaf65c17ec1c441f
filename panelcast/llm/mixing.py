"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's budget of words is met by complete epochs over all its documents and
then a weighted sample without replacement of the rest: every document gets an
exponential key ``-ln(u) / w`` (``u`` from a hash of its id, so reruns agree; ``w``
its quality weight), the source is ordered by key and the keys' prefix sums of
sizes are cut at the remaining budget.

The order within a source is never one task: a document's key is also mapped
monotonically to one of many buckets; bucket totals and their prefix sums give
every bucket its start, and rows are only ordered within their bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.scratch import stored

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0
ROWS_PER_BUCKET = 2_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text (null: 0): words start where a
    word character follows a blank, found without materialising them."""
    blanks = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(blanks, " "), lambda w: w != "")).cast("long")


def share_out(sizes: Sequence[float], weights: Sequence[float], cap: float = MAX_EPOCHS) -> list[float]:
    """Targets that share sum(sizes) by weight, none above ``cap`` times its size;
    the excess of capped sources goes to the others by weight until none is above."""
    target, fixed = [0.0] * len(sizes), set()
    total = float(sum(sizes))
    while True:
        rest = total - sum(target[i] for i in fixed)
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        weight = sum(weights[i] for i in open_)
        if not open_ or weight <= 0:
            return target
        for i in open_:
            target[i] = rest * weights[i] / weight
        over = [i for i in open_ if target[i] > cap * sizes[i]]
        if not over:
            return target
        for i in over:
            target[i] = cap * sizes[i]
            fixed.add(i)


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, rows) per source: by code point, null last, weights
    repeating. One row per source goes through the driver, never a document."""
    spark = sized.sparkSession
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # Python compares str by code point
    targets = share_out([r["source_size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], cap)
    return spark.createDataFrame([(r["source"], int(r["source_size"]), float(t), int(r["rows"])) for r, t in zip(rows, targets)],
                                 "source string, source_size long, target double, rows long")


def quality_weights(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """(doc_id, weight): 2 for labelled good documents, 0.5 for bad ones; others keep 1."""
    return labels.select(F.col(doc_id).alias("doc_id"), F.when(F.col(quality) == 1, 2.0).when(F.col(quality) == 0, 0.5).alias("weight"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        quality: DataFrame | None = None, weights: Sequence[float] = WEIGHTS, cap: float = MAX_EPOCHS,
        rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, taken, epochs.

    ``taken`` = ``epochs`` x size, ``epochs`` the whole passes over the source plus
    one if the document is in the fractional sample. The document the budget
    falls into is taken if at least half of it fits, so a source misses its
    target by at most half a document (only sources of nothing but empty texts
    take nothing). ``quality`` (doc_id, weight) scales the keys: weight 1 where it has none;
    weights that are null, not finite or not above 0 count as 1, of repeated ids the largest counts.
    Null texts have size 0, a null source is a source, null ids hash like 0 with
    the text. Equal keys fall back to id and text; fully equal rows are exchangeable. An empty table gives
    no rows; other columns are not read.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                        word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("tie"))
    sized = stored(sized, "mix-sizes")
    targets = source_targets(sized, weights, cap)
    if quality is not None:
        w = quality.select(F.col(quality.columns[0]).alias("_q"), F.col(quality.columns[1]).cast("double").alias("_w"))
        w = w.filter("_w > 0 and _w < double('Infinity')").groupBy("_q").agg(F.max("_w").alias("_w"))
        sized = sized.join(w, F.col("doc_id") == F.col("_q"), "left").withColumn("weight", F.coalesce("_w", F.lit(1.0)))
    else:
        sized = sized.withColumn("weight", F.lit(1.0))
    # u in (0, 1] from 53 bits of the hash
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(10), "doc_id", "tie"), 11).cast("double") + 1) / F.lit(2.0**53)
    keyed = sized.withColumn("key", -F.log(u) / F.col("weight"))
    of = F.broadcast(targets) if targets.count() <= 10_000 else targets
    of = of.withColumnRenamed("source", "_s")
    keyed = keyed.join(of, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    n = F.greatest(F.ceil(F.col("rows") / rows_per_bucket), F.lit(1))
    # 1 - exp(-key) grows with the key and spreads it over (0, 1)
    keyed = keyed.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * n), n - 1).cast("long"))
    buckets = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("b"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (buckets.withColumn("base", F.coalesce(F.sum("b").over(before), F.lit(0)))
               .select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "base"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = (keyed.withColumn("upto", F.sum("size").over(inside))
              .join(buckets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - passes * F.col("source_size")
    end = F.col("base") + F.col("upto")
    extra = ((F.col("size") > 0) & (end - F.col("size") / 2 <= rest) & (rest > 0)).cast("long")
    epochs = F.least((passes + extra), F.lit(int(cap))).cast("long")
    return placed.select("doc_id", "size", "source", "source_size", "target", (epochs * F.col("size")).alias("taken"),
                         epochs.alias("epochs"), "tie")


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
               quality: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (documents of size 0 never), all columns kept.

    A row's epochs are found by id, source and a hash of its text; equal rows are exchangeable, so
    their epochs are added up and dealt to one of them each.
    """
    taken = mix(docs, doc_id, text, source, quality).filter("epochs > 0")
    taken = taken.groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("tie").alias("_t")).agg(F.sum("epochs").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    keyed = docs.withColumn("_tie", F.xxhash64(F.col(text)))
    same = F.col(doc_id).eqNullSafe(F.col("_d")) & F.col(source).cast("string").eqNullSafe(F.col("_s")) & (F.col("_tie") == F.col("_t"))
    joined = keyed.join(taken, same)
    # of equal rows one carries all their epochs
    first = F.row_number().over(Window.partitionBy("_d", "_s", "_t").orderBy(F.lit(0))) == 1
    several = joined.filter("_rows > 1").withColumn("_first", first).filter("_first").drop("_first")
    rows = joined.filter("_rows = 1").unionByName(several)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select(*[F.col(c) for c in docs.columns])
