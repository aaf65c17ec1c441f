"""Stored daily states merged into periods, against plain Python."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from panelcast.operators.daily_stats import (
    Period,
    daily_stats,
    exact_period_quantiles,
    period_iqr_bounds,
    period_medians,
    period_moments,
    period_quantiles,
    read_daily_stats,
    write_daily_stats,
)
from panelcast.session import scratch_path

DAY0 = dt.date(2020, 1, 1)
PERIODS = [Period("all"), Period("february", dt.date(2020, 2, 1), dt.date(2020, 2, 29)), Period("to march", None, dt.date(2020, 3, 15)),
           Period("nothing", dt.date(2030, 1, 1), dt.date(2030, 1, 2))]
PROBS = [0.0, 0.25, 0.5, 0.99, 1.0]


def _rows():
    rng = random.Random(5)
    rows = []
    for i in range(3_000):
        day = None if i % 97 == 0 else DAY0 + dt.timedelta(days=rng.randrange(120))
        x = rng.choice([None, math.nan, 0.0, -0.0, rng.gauss(0, 50), 10 ** rng.uniform(-8, 8), 7.5, 7.5])
        rows.append((day, rng.choice(["a", "a", "b", None]), x, 1e9 + rng.random()))
    return rows


@pytest.fixture(scope="module")
def stored(spark):
    df = spark.createDataFrame(_rows(), "day date, city string, x double, y double").withColumn("cell", F.lit("clash"))
    path = scratch_path(spark, "daily")
    for k in range(2):  # states of half the rows each
        write_daily_stats(daily_stats(df.filter(F.pmod(F.hash("x", "y"), F.lit(2)) == k), "day", ["x", "y"], by="city"), path)
    return df, path


def _held(period, rows):
    if period.first is None and period.last is None:
        return rows
    return [r for r in rows if r[0] is not None and (period.first is None or r[0] >= period.first) and (period.last is None or r[0] <= period.last)]


def _values(rows, k):
    return sorted(r[k] for r in rows if r[k] is not None and not math.isnan(r[k]))


@pytest.mark.parametrize("by", [None, "city"])
def test_moments_of_periods(spark, stored, by):
    _, path = stored
    got = {(r["period"], r[by] if by else 0, r["column"]): r for r in period_moments(read_daily_stats(spark, path, PERIODS), PERIODS, by).collect()}
    for p in PERIODS[:3]:
        for city in ("a", "b", None) if by else (0,):
            rows = [r for r in _held(p, _rows()) if not by or r[1] == city]
            for k, c in ((2, "x"), (3, "y")):
                v, r = _values(rows, k), got[p.name, city, c]
                assert (r["n"], r["missing"], r["min"], r["max"]) == (len(v), len(rows) - len(v), v[0], v[-1])
                assert r["mean"] == pytest.approx(math.fsum(v) / len(v)) and r["std"] == pytest.approx(statistics.stdev(v), rel=1e-6)
    assert not any(k[0] == "nothing" for k in got)


def test_quantiles_within_the_stated_error(spark, stored):
    _, path = stored
    got = period_quantiles(read_daily_stats(spark, path), PERIODS, PROBS, by="city").collect()
    assert len(got) == 3 * 3 * 2 * len(PROBS)
    for r in got:
        p = next(p for p in PERIODS if p.name == r["period"])
        v = _values([x for x in _held(p, _rows()) if x[1] == r["city"]], 2 if r["column"] == "x" else 3)
        want = v[max(math.ceil(r["prob"] * len(v)), 1) - 1]
        assert r["low"] <= want <= r["high"] and r["low"] in v and r["high"] in v and r["below"] == sum(x < r["low"] for x in v)
        assert abs(r["value"] - want) <= 0.01 * abs(want) * (1 + 1e-9)


def test_exact_quantiles_start_from_the_states(spark, stored):
    df, path = stored
    for p in PERIODS:
        stats = read_daily_stats(spark, path, [p])
        rows = _held(p, _rows())
        got = exact_period_quantiles(df, "day", stats, p, ["x", "y"], PROBS)
        for k, c in ((2, "x"), (3, "y")):
            v = _values(rows, k)
            assert got[c] == [v[max(math.ceil(q * len(v)), 1) - 1] if v else None for q in PROBS]
        medians = period_medians(df, "day", stats, p, ["x"])
        bounds = period_iqr_bounds(df, "day", stats, p, "x")
        assert (medians, bounds) == ({}, None) if not rows else medians["x"] == got["x"][2] and bounds.q1 == got["x"][1]


def test_state_size_does_not_follow_the_rows(spark):
    size = lambda n: daily_stats(spark.range(n).select(F.lit(DAY0).alias("day"), (1 + F.rand(3) * 999).alias("x")), "day", ["x"]).count()
    assert size(20_000) <= size(100_000) <= math.ceil(math.log(1000) / math.log(1.01 / 0.99)) + 1


def test_edges(spark):
    df = spark.createDataFrame([(DAY0, math.inf), (DAY0, -math.inf), (DAY0, 5e-324), (DAY0, 1.7e308), (DAY0, -1.7e308), (None, None)], "day date, x double")
    stats = daily_stats(df, "day", ["x"])
    m = period_moments(stats, [Period("all")]).first()
    assert (m["n"], m["missing"], m["std"], m["min"], m["max"]) == (5, 1, None, -math.inf, math.inf)
    assert exact_period_quantiles(df, "day", stats, Period("all"), ["x"], [0.1, 0.3, 0.5, 0.7, 0.9])["x"] == [-math.inf, -1.7e308, 5e-324, 1.7e308, math.inf]
    none = daily_stats(df.filter("false"), "day", ["x"])
    assert none.count() == 0 == period_moments(none, PERIODS).count() == period_quantiles(none, PERIODS, PROBS).count()
    assert exact_period_quantiles(df.filter("false"), "day", none, Period("all"), ["x"], [0.5]) == {"x": [None]}
    with pytest.raises(ValueError):
        daily_stats(df, "day", ["x"], error=0.5)
    with pytest.raises(ValueError):
        exact_period_quantiles(df.withColumn("x", F.lit(1)), "day", stats, Period("all"), ["x"], [0.5])


def test_only_the_months_of_the_periods_are_read(spark, stored):
    _, path = stored
    read = read_daily_stats(spark, path, [PERIODS[1]])
    assert "PartitionFilters: [isnotnull(month" in read._jdf.queryExecution().toString()
    assert {r["day"].month for r in read.select("day").distinct().collect()} == {2}
