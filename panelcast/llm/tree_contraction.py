"""Subtree totals of any forest by parallel tree contraction.

A round first compresses: every chain of nodes with one child each is taken out at once (pointers to
the only child are doubled until they reach a node that is no such node), the chain's sum is kept
on the edge above the node it ended at. Then it rakes: all leaves give what they have to the node above and
go. A round takes at least half of what is left of the leaves, so rounds grow with the logarithm of
the nodes, whatever the depth or the fan-out. Raked nodes know their totals at that moment; compressed
ones get theirs afterwards, round by round backwards, from the node their chain ended at.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.scratch import stored


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


def _chain_ends(chain: DataFrame, sums: list[str], nodes: int) -> DataFrame:
    """(node, child, sums) with child the node under each chain and the sums of the nodes from
    ``node`` down to it. Only rows that are not there yet are joined, so no end gathers rows.
    ``nodes`` in a chain need no more doublings than its bits; more mean a circle."""
    state = stored(chain.select("node", "child", *sums, F.lit(False).alias("there")), "chains")
    for _ in range(nodes.bit_length() + 1):
        ahead = _renamed(state, _at="node", _child="child", _there="there", **{f"_{s}": s for s in sums})
        joined = state.filter("not there").join(ahead, F.col("child") == F.col("_at"), "left")
        missed = F.col("_at").isNull()
        moved = joined.select("node", F.when(missed, F.col("child")).otherwise(F.col("_child")).alias("child"),
                              *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums],
                              (missed | F.col("_there")).alias("there"))
        state = stored(state.filter("there").union(moved), "chains")
        if state.filter("not there").isEmpty():
            return state.drop("there")
    raise ValueError("the links run in a circle")


def subtree_totals(tree: DataFrame, node: str, up: str, values: Sequence[str]) -> DataFrame:
    """(node, *values): the sums of each value (integers) over the subtree under each node, itself included.

    ``node`` is distinct and not null, of any type that can be ordered; ``up`` is the node above, null or no
    node of the table for a root. Null values count as 0. An empty table gives no rows; links in a
    circle are an error.
    """
    sums, edges = [f"s{i}" for i in range(len(values))], [f"e{i}" for i in range(len(values))]
    active = stored(tree.select(F.col(node).alias("node"), F.col(up).alias("up"),
                                *[F.coalesce(F.col(v).cast("long"), F.lit(0).cast("long")).alias(s) for v, s in zip(values, sums)],
                                *[F.lit(0).cast("long").alias(e) for e in edges]), "tree")
    left_behind, done, before = [], [], None
    while True:
        under = active.filter("up is not null").groupBy("up").agg(
            F.count(F.lit(1)).alias("n"), F.min("node").alias("child"), *[F.sum(e).alias(f"_{e}") for e in edges]).withColumnRenamed("up", "_up")
        now = stored(active.join(under, F.col("node") == F.col("_up"), "left").drop("_up"), "tree")
        rows, chained, leaves = now.agg(F.count(F.lit(1)), F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n").isNull(), 1))).first()
        if not rows:
            break
        if rows == before:
            raise ValueError("the links run in a circle")
        before = rows
        if chained:
            chain = now.filter("n = 1").select("node", "up", "child", *edges, *[(F.col(s) + F.col(f"_{e}")).alias(s) for s, e in zip(sums, edges)])
            ends = _chain_ends(chain, sums, chained)
            left_behind.append(ends)
            inside = chain.select(F.col("node").alias("_node"))
            tops = chain.join(inside, F.col("up") == F.col("_node"), "left_anti")
            tops = _renamed(tops, _top="node", _above="up", **{f"_{e}": e for e in edges})
            moved = ends.join(tops, F.col("node") == F.col("_top")).select(
                F.col("child").alias("_below"), "_above", *[(F.col(s) + F.col(f"_{e}")).alias(f"_m{s}") for s, e in zip(sums, edges)])
            kept = now.filter("n is null or n > 1").join(moved, F.col("node") == F.col("_below"), "left")
            hung = F.col("_below").isNotNull()
            now = stored(kept.select("node", F.when(hung, F.col("_above")).otherwise(F.col("up")).alias("up"), *sums,
                                     *[F.when(hung, F.col(f"_m{s}")).otherwise(F.col(e)).alias(e) for s, e in zip(sums, edges)], "n"), "tree")
        leaf = now.filter("n is null")
        done.append(leaf.select("node", *sums))
        if rows == chained + leaves:
            break
        given = leaf.filter("up is not null").groupBy(F.col("up").alias("_up")).agg(
            *[F.sum(F.col(s) + F.col(e)).alias(f"_{s}") for s, e in zip(sums, edges)])
        active = stored(now.filter("n > 1").join(given, F.col("node") == F.col("_up"), "left").select(
            "node", "up", *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums], *edges), "tree")
    if not done:
        return active.select(F.col("node").alias(node), *[F.col(s).alias(v) for s, v in zip(sums, values)])
    totals = reduce(DataFrame.union, done)
    for ends in reversed(left_behind):
        below = _renamed(totals, _node="node", **{f"_{s}": s for s in sums})
        found = ends.join(below, F.col("child") == F.col("_node")).select("node", *[(F.col(s) + F.col(f"_{s}")).alias(s) for s in sums])
        totals = stored(totals.union(found), "totals")
    return totals.select(F.col("node").alias(node), *[F.col(s).alias(v) for s, v in zip(sums, values)])
