"""As-of and interval joins against plain Python, with hot keys, ties, nulls and empty sides."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelcast.operators.joins import asof_join, interval_join

T0 = dt.datetime(2024, 1, 1)


def _time(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def _sides(seed=4):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    left = [(i, key(), rng.choice([None, *range(0, 60)]), "clash") for i in range(200)]
    right = [(1000 + i, key() if i % 4 else "hot", rng.choice([None, *range(-5, 50)]), float(i)) for i in range(80)]
    return left, right + [(2000, "only right", 3, 1.0)]


@pytest.mark.parametrize("chunk", [4, 50, 200_000])
@pytest.mark.parametrize("direction, exact", [("backward", True), ("backward", False), ("forward", True), ("forward", False)])
def test_asof_equals_brute_force(spark, chunk, direction, exact):
    left, right = _sides()
    l_df = spark.createDataFrame([(i, k, _time(h), x) for i, k, h, x in left], "id long, k string, t timestamp, v string").repartition(3)
    r_df = spark.createDataFrame([(i, k, _time(h), v) for i, k, h, v in right], "rid long, k string, at timestamp, v double").repartition(2)
    out = asof_join(l_df, r_df, "k", "t", "at", ["rid", "v"], ties=["rid"], direction=direction, exact=exact, prefix="r_", chunk_rows=chunk)
    assert out.columns == ["id", "k", "t", "v", "r_rid", "r_v"]
    want = {}
    for i, k, h, _ in left:
        if direction == "backward":
            hits = [(rh, rid, v) for rid, rk, rh, v in right if k is not None and rk == k and None not in (h, rh) and (rh < h or exact and rh == h)]
            best = max(hits, default=(None, None, None))
        else:
            hits = [(rh, rid, v) for rid, rk, rh, v in right if k is not None and rk == k and None not in (h, rh) and (rh > h or exact and rh == h)]
            best = min(hits, default=(None, None, None))
        want[i] = best[1:]
    got = {r["id"]: (r["r_rid"], r["r_v"]) for r in out.collect()}
    assert got == want


def test_asof_with_empty_sides(spark):
    df = spark.createDataFrame([(1, "a", T0)], "id long, k string, t timestamp")
    none = df.filter("false")
    out = asof_join(df, none, "k", "t", columns=["id"], prefix="r_").collect()
    assert [tuple(r) for r in out] == [(1, "a", T0, None)]
    assert asof_join(none, df, "k", "t", columns=["id"], prefix="r_").collect() == []
    with pytest.raises(ValueError):
        asof_join(df, df, "k", "t", direction="nearest")


@pytest.mark.parametrize("cell", [3, 200_000])
def test_interval_join_equals_brute_force(spark, cell):
    rng = random.Random(9)
    points = [(i, rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, *range(-50, 300)])) for i in range(300)] + [(5, "hot", 7), (5, "hot", 7)]
    spans = [(i, rng.choice(["hot", "hot", "a", "b", None]), a := rng.randrange(-60, 300), a + rng.choice([0, 1, 2, 3, 4, 5, 17, 64, 1000, -3])) for i in range(60)]
    spans += [(90, "hot", None, 5), (91, "hot", 5, None), (92, "a", 10, 11), (92, "a", 10, 11)]
    p = spark.createDataFrame(points, "id long, k string, x int").repartition(3)
    s = spark.createDataFrame(spans, "id long, k string, a int, b int").repartition(2)
    out = interval_join(p, s, "k", "x", "a", "b", cell_rows=cell)
    assert out.columns == ["id", "k", "x", "id_interval", "k_interval", "a", "b"]
    want = sorted((i, j) for i, k, x in points for j, q, a, b in spans if k is not None and k == q and None not in (x, a, b) and a <= x < b)
    assert sorted((r["id"], r["id_interval"]) for r in out.collect()) == want and want
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert interval_join(p, s.filter("false"), "k", "x", "a", "b").collect() == [] and interval_join(p.filter("false"), s, "k", "x", "a", "b").collect() == []


def test_a_hot_bin_is_split(spark):
    """All points ask the same bin: no (cell, salt) group holds many more than ``cell_rows`` of them."""
    p = spark.range(4000).select(F.lit("k").alias("k"), (F.col("id") % 7).alias("x"), "id")
    s = spark.createDataFrame([("k", 0, 8), ("k", 2, 5)], "k string, a long, b long")
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for c, v in zip(before, ("false", "-1", "97")):
        spark.conf.set(c, v)
    try:
        out = interval_join(p, s, "k", "x", "a", "b", cell_rows=100).withColumn("task", F.spark_partition_id())
        per_task = [r["count"] for r in out.groupBy("task").count().collect()]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sum(per_task) == sum(1 for i in range(4000)) + sum(1 for i in range(4000) if 2 <= i % 7 < 5)
    assert len(per_task) > 20 and max(per_task) < 1000


def test_interval_bins_of_timestamps(spark):
    p = spark.createDataFrame([("a", T0 + dt.timedelta(days=d)) for d in range(10)], "k string, t timestamp").withColumn("n", F.col("t").cast("timestamp_ntz"))
    s = spark.createDataFrame([("a", T0 + dt.timedelta(days=2), T0 + dt.timedelta(days=5))], "k string, lo timestamp, hi timestamp")
    assert interval_join(p, s, "k", "t", "lo", "hi").count() == 3
    days = s.select("k", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))
    assert interval_join(p.select("k", F.to_date("t").alias("t")), days, "k", "t", "lo", "hi").count() == 3


@pytest.mark.parametrize("run", [3, 50, 200_000])
def test_totals_of_the_pairs_without_the_pairs(spark, run):
    rng = random.Random(11)
    points = [(i, rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(-20, 80)])) for i in range(200)] + [(5, "hot", 7), (5, "hot", 7)]
    spans = [(rng.choice([None, i]), rng.choice(["hot", "hot", "a", "b", None]), a := rng.randrange(-30, 80), a + rng.choice([0, 1, 2, 17, 64, -3])) for i in range(60)]
    spans += [(90, "hot", None, 5), (91, "hot", 5, None), (92, "a", 10, 11), (92, "a", 10, 11), (None, "b", 0, 3)]
    p = spark.createDataFrame([*points, (900, "b", 1)], "id long, k string, x int").repartition(3)
    s = spark.createDataFrame(spans, "sid long, k string, a int, b int").repartition(2)
    pairs = interval_join(p, s, "k", "x", "a", "b").groupBy("id", "k", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("sid").alias("t"))
    made = interval_join(p, s, "k", "x", "a", "b", cell_rows=run, totals={"n": None, "t": "sid"})
    assert made.columns == ["id", "k", "x", "n", "t"]
    got = made.groupBy("id", "k", "x").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert order(got) == order(pairs) and any(r["t"] is None for r in got.collect())
    with pytest.raises(TypeError):
        interval_join(p, s.withColumn("v", F.lit(0.5)), "k", "x", "a", "b", totals={"t": "v"})
