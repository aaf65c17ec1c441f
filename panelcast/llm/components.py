"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.session import checkpoint_dir


def _linked_to_least(directed: DataFrame) -> DataFrame:
    """``directed`` (u, v) with ``m``, the least of u and its neighbours. The
    least is a map-side combined aggregate, so a hub's list is never gathered."""
    least = directed.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return directed.join(least.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u")).drop("_u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _linked_to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = _linked_to_least(down)
    onto = stars.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = stars.select("u", F.col("m").alias("v"))
    return onto.union(own)


def _state(links: DataFrame) -> DataFrame:
    return links.filter("u <> v").distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component_id) of every node that has a link to another; the id is
    the component's smallest node.

    Null ends and loops link nothing; repeated links count once; no links give
    no rows. Both steps alternate until neither changes the links; each round is
    checkpointed in the shared folder.
    """
    checkpoint_dir(links.sparkSession)
    state = _state(links.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()).checkpoint()
    before = None
    while True:
        state = _state(_small_star(_large_star(state))).checkpoint()
        # the links are stars when no end is also a centre; the sums detect it in one pass
        row = state.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if (row[0], row[1]) == before:
            break
        before = (row[0], row[1])
    down = state.groupBy("u").agg(F.min("v").alias("component_id")).select(F.col("u").alias("node"), "component_id")
    centres = state.select(F.col("v").alias("node")).distinct().withColumn("component_id", F.col("node"))
    return down.union(centres)
