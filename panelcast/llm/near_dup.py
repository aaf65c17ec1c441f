"""Near-duplicate documents: MinHash with banding, signature and set checks,
components by large-star/small-star.

1. One scan makes each text's set of word shingles (64-bit hashes), a 128-bit
   digest of the set and, per band, a hash of ``ROWS`` universal minima.
2. Texts of equal sets are one class, stood for by its smallest id; from here
   on only class representatives are compared, so exact copies cost one row.
3. Band buckets of two or more are stars: every member is compared with one
   member, the bucket's pivot (an aggregate and a join; no bucket is gathered).
   The best pivots by signature are confirmed on the full sets.
4. After a components pass only buckets that still hold several components
   are open. The largest component of each, with all that meet it in a bucket,
   is a family; its members outside that component meet all others in blocks of bounded
   size, by signature and, where any is close, by full set. So every
   pair of a bucket is in one component, or was compared.
5. Components of all confirmed links.

Bands: 36 of 6 minima find a pair at similarity 0.8 with probability
1 - (1 - 0.8**6)**36 = 1 - 2e-5, and more so above it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from panelcast.llm.components import connected_components
from panelcast.llm.scratch import stored
from panelcast.llm.words import as_strings, chunks, hash_words, mix64, split_words

BANDS, ROWS = 36, 6
#: A signature estimate under the similarity by four standard errors rules a pair out.
SLACK = 4.0
MINOR_BLOCK, MEMBER_BLOCK = 128, 1024
#: Pivots each document is confirmed against before open buckets are compared in full.
PIVOTS = 3

_RNG = np.random.Generator(np.random.PCG64(7_700_417))
_MUL = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_FOLD = _RNG.integers(0, 2**64, ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each text, words
    as ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; fewer words than ``width`` make
    one shingle of all, none make an empty set."""
    codes, first, distinct = split_words(pc.ascii_lower(texts))
    h = hash_words(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    rolled = h.copy()
    for k in range(1, width):
        if len(h) > k:
            rolled[:-k] = mix64(rolled[:-k] * np.uint64(0x9E3779B97F4A7C15) + h[k:])
    out = []
    for i in range(len(first) - 1):
        a, n = first[i], first[i + 1] - first[i]
        if n >= width:
            out.append(np.unique(rolled[a:a + n - width + 1]))
        elif n:
            one = np.array([n], np.uint64)
            for k in range(a, a + n):
                one = mix64(one * np.uint64(0x9E3779B97F4A7C15) + h[k:k + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash (multiply, add, keep the high half) over a set."""
    x = shingles >> np.uint64(32)
    least = np.full(len(_MUL), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 512):
        part = np.multiply.outer(_MUL, x[at:at + 512])
        part += _ADD[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least >> np.uint64(32)


def bands(least: np.ndarray) -> np.ndarray:
    """One 64-bit value per band."""
    return mix64((least.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _digest(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _scan(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, sketch (a byte of each minimum), band values."""
    schema = StructType([StructField("doc_id", LongType()), StructField("n_shingles", LongType()),
                         StructField("digest", BinaryType()), StructField("sketch", BinaryType()),
                         StructField("band", ArrayType(LongType()))])

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(as_strings(part.column(1)), width)
                sketches, values = [], []
                for s in sets:
                    least = minima(s) if len(s) else None
                    sketches.append(None if least is None else (least & np.uint64(255)).astype(np.uint8).tobytes())
                    values.append(None if least is None else bands(least))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()),
                     pa.array(sketches, pa.binary()), pa.array(values, pa.list_(pa.int64()))], names=schema.names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def _full_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(id, set) of the documents in ``wanted`` (id), made again from their texts. A
    repeated doc_id keeps each of its rows apart by digest."""
    schema = StructType([StructField("id", LongType()), StructField("digest", BinaryType()), StructField("members", BinaryType())])

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(as_strings(part.column(1)), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([_digest(s) for s in sets], pa.binary()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], names=schema.names)

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    made = rows.join(wanted.select("id").distinct(), "id", "left_semi").mapInArrow(run, schema)
    return made.join(wanted, ["id", "digest"], "left_semi").dropDuplicates(["digest"])


def _floor(percent: int) -> float:
    """Least share of equal minima of a pair that may reach the similarity."""
    j = percent / 100
    return j - SLACK * (j * (1 - j) / (BANDS * ROWS)) ** 0.5


def _alike(sketch_a: str, sketch_b: str):
    """Share of places in which two signatures agree."""

    @F.pandas_udf("double")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
        y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
        return pd.Series((x == y).mean(axis=1))

    return agree(F.col(sketch_a), F.col(sketch_b))


def _are_linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """100 * |both| >= percent * |either| of two sorted sets."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y: digests) with 100 * |both| >= percent * |either| on the full sets."""

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_are_linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(a, b)], dtype=bool)

    left = sets.select(F.col("digest").alias("x"), F.col("members").alias("_a"))
    right = sets.select(F.col("digest").alias("y"), F.col("members").alias("_b"))
    return pairs.join(left, "x").join(right, "y").filter(linked("_a", "_b")).select("x", "y")


def _blocks(digests: pd.Series, sketch: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sketch), np.uint8).reshape(len(digests), -1)


def _unit(percent: int, full: bool):
    """Minors and members of one block pair of a family. From sketches: the minors that are close to a
    member of another component. From ``full`` sets: for each minor and other component one linked pair."""
    floor = _floor(percent)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        minors, members = rows[rows["minor"]], rows[~rows["minor"]]
        xs, ys = [], []
        if len(minors) and len(members):
            a, b = _blocks(minors["digest"], minors["sketch"]), _blocks(members["digest"], members["sketch"])
            of, own = members["component"].to_numpy(), minors["component"].to_numpy()
            if full:
                sets = [np.frombuffer(m, np.uint64) for m in members["members"]]
            for i in range(len(minors)):
                other = np.flatnonzero(of != own[i])
                close = other[(b[other] == a[i]).mean(axis=1) >= floor]
                if not full:
                    if len(close):
                        xs.append(minors["digest"].iloc[i])
                        ys.append(minors["digest"].iloc[i])
                    continue
                mine, met = np.frombuffer(minors["members"].iloc[i], np.uint64), set()
                for j in close:
                    if of[j] not in met and _are_linked(mine, sets[j], percent):
                        met.add(of[j])
                        xs.append(minors["digest"].iloc[i])
                        ys.append(members["digest"].iloc[j])
        return pd.DataFrame({"x": xs, "y": ys})

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A & B| >= ``percent`` * |A | B| for their
    shingle sets; a component is all that is reachable and is named by its
    smallest doc_id. Null and blank texts have an empty set, are linked with
    nothing and kept. Rows of a null doc_id are linked with nothing (component
    null, kept). Repeated rows of one doc_id share its component (their sets are
    compared one by one). An empty table gives no rows; other columns are not read.
    """
    scanned = stored(_scan(docs, doc_id, text, width), "minhash")
    live = scanned.filter("digest is not null and doc_id is not null")
    # rows of one doc_id with different texts are one node: linked below by their classes
    classes = live.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"),
                                          F.first("band").alias("band"))
    classes = stored(classes, "classes")

    # stars of the band buckets
    spread = classes.select("rep", F.posexplode("band").alias("no", "value"))
    # a bucket's pivot is a member drawn by a hash that differs from band to band, so a large family's
    # members meet many different pivots
    drawn = F.min(F.struct(F.xxhash64("no", "rep").alias("h"), "rep")).alias("drawn")
    least = (spread.groupBy("no", "value").agg(drawn, F.count(F.lit(1)).alias("n")).filter("n > 1")
             .select("no", "value", F.col("drawn.rep").alias("pivot")))
    near = (spread.join(least, ["no", "value"]).filter("rep <> pivot").select("rep", "pivot").distinct())
    by_rep = classes.select("rep", "digest", "sketch")
    near = (near.join(by_rep, "rep").withColumnRenamed("digest", "x").withColumnRenamed("sketch", "sx")
            .join(by_rep.select(F.col("rep").alias("pivot"), F.col("digest").alias("y"), F.col("sketch").alias("sy")), "pivot"))
    scored = near.select("x", "y", "rep", "pivot", _alike("sx", "sy").alias("agree")).filter(F.col("agree") >= _floor(percent))
    order = Window.partitionBy("x").orderBy(F.desc("agree"), "pivot")
    best = stored(scored.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= PIVOTS)
                  .select("x", "rep", "y", "pivot"), "pivots")
    wanted = best.select(F.col("rep").alias("id"), F.col("x").alias("digest")).union(best.select("pivot", "y")).distinct()
    links = stored(_confirmed(best.select("x", "y"), _full_sets(docs, wanted, doc_id, text, width), percent), "links")

    named = _class_components(live, classes, links)
    more = _links_across(docs, classes, named, doc_id, text, width, percent)
    if more is not None:
        named = _class_components(live, classes, links.union(more))
    # every row through its class
    out = scanned.join(named.select("digest", F.col("component").alias("_c")), "digest", "left")
    component = F.when(F.col("_c").isNull(), F.col("doc_id")).otherwise(F.col("_c"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _class_components(live: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """(digest, rep, component) of every class; component = smallest doc_id reachable."""
    key = classes.select("digest", "rep")
    ends = (links.join(key.select(F.col("digest").alias("x"), F.col("rep").alias("a")), "x")
            .join(key.select(F.col("digest").alias("y"), F.col("rep").alias("b")), "y").select("a", "b"))
    # a doc_id with several texts belongs to several classes, which it joins
    several = live.select("doc_id", "digest").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    joins = (live.join(several, "doc_id", "left_semi").select("doc_id", "digest").distinct()
             .join(key, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = connected_components(ends.union(joins), "a", "b")
    return stored(key.join(found.select(F.col("node").alias("rep"), "component_id"), "rep", "left")
                  .select("digest", "rep", F.coalesce("component_id", "rep").alias("component")), "components")


def _links_across(docs: DataFrame, classes: DataFrame, named: DataFrame, doc_id: str, text: str, width: int,
                  percent: int) -> DataFrame | None:
    """Links (x, y) between components that still share a band bucket; None if no pair is close.

    A family is the largest component of such a bucket, with all classes (minors) that meet it in any
    bucket: every pair across components of a bucket is a pair of one family with a minor in it.
    Families are compared in blocks, first by sketches; those with a close pair also by full sets.
    """
    rows = classes.select("digest", F.posexplode("band").alias("no", "value")).join(named.select("digest", "component"), "digest")
    parts = rows.groupBy("no", "value", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = (parts.groupBy("no", "value").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "component")).alias("largest"))
             .filter("parts > 1").select("no", "value", F.col("largest.component").alias("family")))
    minors = stored(rows.join(mixed, ["no", "value"]).filter("component <> family").select("family", "digest", "component").distinct(), "minors")
    families = minors.select("family").distinct()
    core = named.join(families, F.col("component") == F.col("family")).select("family", "digest", "component")
    members = stored(core.union(minors), "families")

    close = stored(_in_blocks(minors, members, classes.select("digest", "sketch"), percent, False).select("family", F.col("x").alias("digest")).distinct(), "close")
    if close.isEmpty():
        return None
    minors = minors.join(close, ["family", "digest"], "left_semi")
    members = members.join(close.select("family").distinct(), "family", "left_semi")
    wanted = members.select("digest").distinct().join(classes.select("digest", F.col("rep").alias("id")), "digest")
    sets = _full_sets(docs, wanted, doc_id, text, width).select("digest", "members").join(classes.select("digest", "sketch"), "digest")
    return stored(_in_blocks(minors, members, stored(sets, "family-sets"), percent, True).select("x", "y").distinct(), "more")


def _in_blocks(minors: DataFrame, members: DataFrame, payload: DataFrame, percent: int, full: bool) -> DataFrame:
    """(family, x, y) from every block of a family's minors against every block of its members."""
    sizes = (members.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / MEMBER_BLOCK).cast("int").alias("nj"))
             .join(minors.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / MINOR_BLOCK).cast("int").alias("ni")), "family"))
    block = lambda n: F.pmod(F.xxhash64("digest"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sides = []
    for side, is_minor in ((minors, True), (members, False)):
        side = side.join(sizes, "family").join(payload, "digest")
        i, j = (block("ni"), every("nj")) if is_minor else (every("ni"), block("nj"))
        sides.append(side.withColumn("i", i).withColumn("j", j).withColumn("minor", F.lit(is_minor)).drop("ni", "nj"))
    run = _unit(percent, full)

    def unit(key, rows):
        return run(rows).assign(family=key[0])

    return sides[0].unionByName(sides[1]).groupBy("family", "i", "j").applyInPandas(unit, "x binary, y binary, family long")
