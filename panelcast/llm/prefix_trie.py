"""Conversation prefix trie: shared beginnings of conversations as nodes, with subtree totals.

A node is a sequence of turns that some conversation starts with. It is found without comparing
conversations: every turn is hashed with its place, and the sums of these hashes along a conversation
(128 bits) name its prefixes, so equal prefixes meet in one aggregate. Sums along a conversation are
taken within stretches of ``STRETCH`` turns that start from the sums of the stretches before, so one
very long conversation is many tasks. Texts are read once and never shuffled.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.mixing import word_count
from panelcast.llm.scratch import stored
from panelcast.llm.tree_contraction import subtree_totals
from panelcast.operators.windows import with_positions
from panelcast.panel import PanelSpec

#: Conversations share turns with the first of their family of this many ids; up to SHARED - 1 of them.
FAMILY, SHARED = 20, 4
STRETCH = 4096
#: Consecutive conversation ids whose decimals are joined into one text: at most that many ids.
ID_BLOCK = 4096
_LOW = (1 << 32) - 1


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, c1, c2, words): place of each turn in its conversation, two hashes of role and
    text, words of the text. Null turns come first; equal turns are ordered by the hashes. Rows
    without a conversation id belong to none and are left out."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                                F.xxhash64(r, t).alias("c1"), F.xxhash64(F.lit(11), t, r).alias("c2"), word_count(t).alias("words"))
    rows = stored(rows.filter("conv_id is not null"), "turns")
    spec = PanelSpec("conv_id", "turn", ("c1", "c2"), time_bucket=STRETCH)
    return with_positions(rows, spec, "pos").select("conv_id", F.col("pos").cast("long").alias("pos"), "c1", "c2", "words")


def rebuilt(placed: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after each conversation's first h turns were replaced by those of the first
    of its family; h is the crc32 of its decimal id modulo ``shared``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("long")
    own = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    first = F.col("conv_id") - F.col("conv_id") % family
    own = stored(own.withColumns({"h": h, "first": first}), "conversations")
    heads = own.filter("conv_id = first").select(F.col("conv_id").alias("_first"), F.col("own").alias("_own"))
    taken = F.least(F.col("h"), F.coalesce("_own", F.lit(0)))
    ids = own.join(heads, F.col("first") == F.col("_first"), "left").select(
        "conv_id", "first", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    ids = stored(ids, "conversations")
    start = placed.filter((F.col("pos") < shared - 1) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "_first")
    given = ids.join(start, (F.col("first") == F.col("_first")) & (F.col("pos") < F.col("h")))
    rest = placed.join(ids.withColumnRenamed("conv_id", "_conv"), (F.col("conv_id") == F.col("_conv")) & (F.col("pos") >= F.col("h")))
    kept = rest.withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "pos", "c1", "c2", "words", "length"]
    return ids.select("conv_id", "length"), stored(given.select(columns).union(kept.select(columns)), "rebuilt")


def _halves(x: Column) -> list[Column]:
    return [x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 32)]


def _key(sums: list[Column]) -> list[Column]:
    """Two 64-bit numbers of four sums modulo 2**32."""
    low = [s.bitwiseAND(F.lit(_LOW)) for s in sums]
    return [F.shiftleft(low[i], 32).bitwiseOR(low[i + 1]) for i in (0, 2)]


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, words, length, k1, k2, p1, p2): the name of the prefix up to each turn and of the one before."""
    parts = [*_halves(F.xxhash64("pos", "c1", "c2")), *_halves(F.xxhash64(F.lit(5), "c2", "pos", "c1"))]
    names = ["x0", "x1", "x2", "x3"]
    rows = rows.withColumns({**dict(zip(names, parts)), "stretch": F.floor(F.col("pos") / STRETCH).cast("long")})
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = (rows.filter(F.col("length") > STRETCH).groupBy("conv_id", "stretch").agg(*[F.sum(x).alias(x) for x in names])
            .select(F.col("conv_id").alias("_conv"), F.col("stretch").alias("_stretch"), *[F.sum(x).over(before).alias(f"_{x}") for x in names]))
    inside = Window.partitionBy("conv_id", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(base, (F.col("conv_id") == F.col("_conv")) & (F.col("stretch") == F.col("_stretch")), "left")
    rows = rows.withColumns({f"y{i}": F.sum(x).over(inside) + F.coalesce(f"_{x}", F.lit(0)) for i, x in enumerate(names)})
    here, above = _key([F.col(f"y{i}") for i in range(4)]), _key([F.col(f"y{i}") - F.col(f"x{i}") for i in range(4)])
    return rows.select("conv_id", "pos", "words", "length", here[0].alias("k1"), here[1].alias("k2"), above[0].alias("p1"), above[1].alias("p2"))


def ends(ids: DataFrame, named: DataFrame) -> DataFrame:
    """(k1, k2, block, ids): conversations that end at each node, decimal ids ascending and joined by commas,
    in blocks of ``ID_BLOCK`` consecutive numbers."""
    none = F.lit(0).cast("long")
    at = named.filter("pos + 1 = length").select("k1", "k2", "conv_id").union(ids.filter("length = 0").select(none.alias("k1"), none.alias("k2"), "conv_id"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    return at.groupBy("k1", "k2", F.floor(F.col("conv_id") / ID_BLOCK).cast("long").alias("block")).agg(listed.alias("ids"))


def _digests(listed: DataFrame) -> DataFrame:
    """(k1, k2, sha): SHA-256 of each node's ids. The blocks of a node pass through one hash in order,
    so nothing of a node is held but the hash."""

    def run(batches):
        held, made = None, None
        for batch in batches:
            k1, k2, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            out = []
            for a, b, x in zip(k1, k2, ids):
                if (a, b) != held:
                    if held:
                        out.append((*held, made.hexdigest()))
                    held, made = (a, b), hashlib.sha256(x.encode())
                else:
                    made.update(b"," + x.encode())
            yield _rows(out)
        if held:
            yield _rows([(*held, made.hexdigest())])

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                                           pa.array([r[2] for r in out], pa.string())], names=["_k1", "_k2", "sha"])

    return listed.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block").mapInArrow(run, "_k1 long, _k2 long, sha string")


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """One row per node: conv_id (smallest member) and depth, which name it; parent_conv_id; n_convs, n_children, n_leaves,
    saved_tokens; ends_sha256.

    ``saved_tokens`` adds up, over the subtree, the words of each node's last text that its members after
    the first need not repeat. Null roles and texts are empty, null turns come first, turns of equal number are
    ordered by a hash (repeated rows are turns each), rows without a conversation id are left out. A
    conversation may have no turns after rebuilding; it is then a member of the root alone. Other columns are not
    read; no conversations give no rows.
    """
    ids, rows = rebuilt(stored(turns(conversations, conv_id, turn, role, text), "placed"), family, shared)
    named = stored(prefixes(rows), "prefixes")
    zero = F.lit(0).cast("long")
    nodes = named.groupBy("k1", "k2").agg(F.min("conv_id").alias("conv_id"), (F.min("pos") + 1).alias("depth"), F.count(F.lit(1)).alias("n_convs"),
                                          F.max("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        zero.alias("k1"), zero.alias("k2"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("words"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    nodes = stored(nodes.unionByName(root), "nodes")
    above = nodes.select(F.col("k1").alias("_p1"), F.col("k2").alias("_p2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(above, (F.col("p1") == F.col("_p1")) & (F.col("p2") == F.col("_p2")), "left").drop("_p1", "_p2")
    children = nodes.filter("depth > 0").groupBy(F.col("p1").alias("_p1"), F.col("p2").alias("_p2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, (F.col("k1") == F.col("_p1")) & (F.col("k2") == F.col("_p2")), "left").drop("_p1", "_p2")
    nodes = nodes.join(_digests(ends(ids, named)), (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    name = F.struct("conv_id", "depth")
    over = F.when(F.col("depth") > 0, F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")))
    nodes = stored(nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
                                F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"), name.alias("node"), over.alias("up"),
                                F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"),
                                ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "nodes")
    totals = subtree_totals(nodes, "node", "up", ["leaf", "saved"]).select(F.col("node").alias("_node"), F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    return nodes.join(totals, F.col("node") == F.col("_node")).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
