"""Exact discrete quantiles agree with brute force (k = ceil(p * n)-th smallest,
nulls and NaN ignored) for every type, number of bins and infinite value."""

import datetime as dt
import decimal
import math
import random

import pytest
from pyspark.sql import functions as F

from panelcast.operators.quantiles import exact_group_quantiles, exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.8, 0.999, 1.0]


def brute(values, p):
    xs = sorted(v for v in values if v is not None and not (isinstance(v, float) and math.isnan(v)))
    if not xs:
        return None
    k = min(max(math.ceil(p * len(xs)), 1), len(xs))
    return xs[k - 1]


@pytest.mark.parametrize("bins", [4096, 16, 2])
def test_matches_brute_force(spark, bins):
    rng = random.Random(7)
    a = [rng.choice([1.0, 2.0, 2.0, 3.5, 1000.0, -4.0]) for _ in range(400)]       # heavy ties
    b = [rng.expovariate(0.01) for _ in range(400)]                                   # skewed
    b[3], b[9], a[5] = None, float("nan"), None
    c = [5.0] * 400                                                                    # constant
    df = spark.createDataFrame(list(zip(a, b, c)), "a double, b double, c double")
    got = exact_quantiles(df, ["a", "b", "c"], PROBS if bins > 2 else [0.5], bins=bins)
    for col, vals in (("a", a), ("b", b), ("c", c)):
        assert got[col] == [brute(vals, p) for p in (PROBS if bins > 2 else [0.5])], col


def test_extreme_ranges_and_infinities(spark):
    vals = [-math.inf, math.inf, math.inf, 1.7e308, -1.7e308, 5e-324, 0.0, 1.0, 1.0 + 2**-52, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert exact_quantiles(df, ["x"], PROBS)["x"] == [brute(vals, p) for p in PROBS]


def test_types_are_kept(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i % 30) for i in range(100)]
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=7919 * i * i) for i in range(100)]
    longs = [2**53 + i for i in range(100)]
    decs = [decimal.Decimal(i) / 8 for i in range(100)]
    df = spark.createDataFrame(list(zip(days, times, times, longs, decs, [None] * 100)),
                               "d date, t timestamp, z timestamp_ntz, l long, m decimal(20,3), e double")
    got = exact_quantiles(df, ["d", "t", "z", "l", "m", "e"], [0.3, 0.8], bins=4)
    for c, v in (("d", days), ("t", times), ("z", times), ("l", longs), ("m", decs)):
        assert got[c] == [brute(v, 0.3), brute(v, 0.8)], c
    assert got["e"] == [None, None]


def test_timestamp_split(spark):
    from panelcast.operators.split import chronological_split
    rows = [(2024, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(50)]
    df = spark.createDataFrame(rows, "year int, ts timestamp")
    train, test = chronological_split(df, 0.8, date_col="ts")
    assert (train.count(), test.count()) == (40, 10)


@pytest.mark.parametrize("bins", [512, 4])
def test_group_quantiles_match_brute_force(spark, bins):
    rng = random.Random(3)
    rows = [("hot", rng.choice([1.0, 2.0, 2.5, 9.0]) if i % 3 else rng.uniform(0, 50)) for i in range(300)]
    rows += [("inf", 1.0), ("inf", math.inf), ("inf", math.inf), ("inf", 2.0), ("inf", -math.inf)]
    rows += [("cold", float(i)) for i in range(7)] + [("one", 4.0), ("nan", float("nan")), (None, 3.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r["g"], r["prob_idx"]): r["value"] for r in exact_group_quantiles(df, "g", "x", PROBS, bins).collect()}
    for g in ("hot", "inf", "cold", "one", None):
        vals = [x for gg, x in rows if gg == g]
        for j, p in enumerate(PROBS):
            assert got[(g, j)] == brute(vals, p), (g, p)
    assert not any(k[0] == "nan" for k in got)


def test_a_group_above_every_former_limit(spark):
    from pyspark.sql import functions as F
    df = spark.range(30_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 30_000).cast("double").alias("x"))
    got = {r["prob_idx"]: r["value"] for r in exact_group_quantiles(df, "g", "x", [0.25, 0.75]).collect()}
    assert got == {0: 7499.0, 1: 22499.0}


@pytest.mark.parametrize("few, hot", [(100_000, 1_000_000), (0, 50), (0, 1_000_000)])
def test_group_intervals_do_not_gather_a_group(spark, monkeypatch, few, hot):
    import panelcast.operators.quantiles as q
    monkeypatch.setattr(q, "BROADCAST_INTERVALS", few)
    monkeypatch.setattr(q, "HOT_ROWS", hot)
    df = spark.range(400).select(F.when(F.col("id") % 4 > 0, F.lit("hot")).when(F.col("id") % 8 == 0, F.lit("a")).alias("g"),
                                 (F.pmod(F.xxhash64("id"), F.lit(1000)) / 7).alias("x"))
    got = {(r["g"], r["prob_idx"]): r["value"] for r in q.exact_group_quantiles(df, "g", "x", [0.25, 0.9], bins=4).collect()}
    for g in ("hot", "a", None):
        xs = sorted(r["x"] for r in df.filter(F.col("g").eqNullSafe(F.lit(g))).collect())
        for j, p in enumerate((0.25, 0.9)):
            assert got[g, j] == xs[math.ceil(p * len(xs)) - 1]
    base = df.select(F.col("g").alias("_g"), F.col("x").alias("_x"))
    iv = spark.createDataFrame([("hot", True)], "_h string, _hot boolean")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = q._with_intervals(base, iv, True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
