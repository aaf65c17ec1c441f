"""Panel windows: hand-checked lead/lag/rolling, and the chunked (skew-safe)
plan equals the plain plan on real tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelcast.operators.features import forecast_target, lag_features, panel_features, rolling_mean
from panelcast.operators.sequences import positional_split, sequence_windows
from panelcast.operators.windows import add_window_columns, position_cells, with_positions
from panelcast.panel import PanelSpec
from panelcast.sources.adapters import EVENTS_SPEC, events_panel

from conftest import SF001

SPEC = PanelSpec("city", "t", ("k",), time_bucket=1_000)


@pytest.fixture(scope="module")
def tiny(spark):
    # city A: 30 rows with duplicate times (tie-breaker k); city B: 5 rows
    rows = [("A", i // 2, i, float(i)) for i in range(30)] + [("B", i, i, 100.0 + i) for i in range(5)]
    return spark.createDataFrame(rows, "city string, t int, k int, v double")


def _by_key(df, col):
    return {(r["city"], r["k"]): r[col] for r in df.collect()}


def test_lead_lag_rolling_by_hand(spark, tiny):
    out = panel_features(tiny, SPEC, "v", lags=(1, 24), rolling=(24,), drop_null_target=False)
    got = {(r["city"], r["k"]): r for r in out.collect()}
    a = got[("A", 25)]
    assert a["v_target"] == 26.0 and a["v_lag1"] == 24.0 and a["v_lag24"] == 1.0
    assert a["v_rolling_24"] == pytest.approx(sum(range(2, 26)) / 24)
    assert got[("A", 29)]["v_target"] is None
    assert got[("A", 0)]["v_rolling_24"] == 0.0  # partial frame kept
    # the 5-row entity never gets a 24-row lag: no full feature row
    assert all(got[("B", k)]["v_lag24"] is None for k in range(5))


def test_target_drop_keeps_backward_features(spark, tiny):
    kept = forecast_target(tiny, SPEC, "v")
    assert kept.count() == 35 - 2


@pytest.mark.parametrize("chunk", [3, 7, 24, 25])
def test_chunked_equals_plain_tiny(spark, tiny, chunk):
    cols = {"lead1": lambda w: F.lead("v", 1).over(w),
            "lag24": lambda w: F.lag("v", 24).over(w),
            "roll": lambda w: F.avg("v").over(w.rowsBetween(-23, 0))}
    lookback = 24
    if chunk < lookback:
        with pytest.raises(ValueError):
            add_window_columns(tiny, SPEC, cols, lookback, 1, strategy="chunked", chunk_rows=chunk)
        return
    plain = add_window_columns(tiny, SPEC, cols, lookback, 1, strategy="plain")
    chunked = add_window_columns(tiny, SPEC, cols, lookback, 1, strategy="chunked", chunk_rows=chunk)
    for c in cols:
        assert _by_key(plain, c) == _by_key(chunked, c)


def test_chunked_equals_plain_events(spark):
    ev = events_panel(spark, SF001)
    plain = panel_features(ev, EVENTS_SPEC, "value", strategy="plain")
    chunked = panel_features(ev, EVENTS_SPEC, "value", strategy="chunked", chunk_rows=25)
    cols = ["event_id", "value_target", "value_lag1", "value_lag24", "value_rolling_24"]
    a = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in plain.select(*cols).collect())
    b = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in chunked.select(*cols).collect())
    assert a == b and len(a) > 0


def test_positions_exact(spark):
    ev = events_panel(spark, SF001)
    pos = with_positions(ev, EVENTS_SPEC, "rn", "n")
    from pyspark.sql import Window
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ref = ev.select("event_id", (F.row_number().over(w) - 1).alias("rn"),
                    F.count("*").over(Window.partitionBy("user_id")).alias("n"))
    assert sorted(pos.select("event_id", "rn", "n").collect()) == sorted(ref.collect())


def test_stable_under_repartition(spark, tiny):
    a = panel_features(tiny, SPEC, "v", drop_null_target=False).select("city", "k", "v_lag1", "v_rolling_24")
    b = panel_features(tiny.repartition(7), SPEC, "v", drop_null_target=False).select(
        "city", "k", "v_lag1", "v_rolling_24")
    assert sorted(a.collect()) == sorted(b.collect())


def test_future_change_leaves_past_features(spark, tiny):
    changed = tiny.withColumn("v", F.when((F.col("city") == "A") & (F.col("k") == 29), 1e6).otherwise(F.col("v")))
    cols = ["city", "k", "v_lag1", "v_lag24", "v_rolling_24"]
    a = panel_features(tiny, SPEC, "v", drop_null_target=False).select(*cols).filter("k < 29")
    b = panel_features(changed, SPEC, "v", drop_null_target=False).select(*cols).filter("k < 29")
    assert sorted(a.collect()) == sorted(b.collect())


def test_lag_and_rolling_helpers(spark, tiny):
    lagged = lag_features(tiny, SPEC, "v", (2,))
    assert _by_key(lagged, "v_lag2")[("A", 5)] == 3.0
    rolled = rolling_mean(tiny, SPEC, "v", 3, min_periods=3)
    r = _by_key(rolled, "v_rolling_3")
    assert r[("A", 1)] is None and r[("A", 2)] == pytest.approx(1.0)


@pytest.mark.parametrize("strategy", ["plain", "chunked"])
def test_sequences_known_length_and_order(spark, tiny, strategy):
    seq = sequence_windows(tiny, SPEC, ["v"], "v", window=4, dtype="double", strategy=strategy, chunk_rows=5)
    got = {(r["city"], r["k"]): [x[0] for x in r["seq"]] for r in seq.collect()}
    assert len(got) == (30 - 4) + (5 - 4)
    assert got[("A", 10)] == [6.0, 7.0, 8.0, 9.0]
    assert got[("B", 4)] == [100.0, 101.0, 102.0, 103.0]


@pytest.mark.parametrize("strategy", ["plain", "chunked"])
def test_positional_split(spark, tiny, strategy):
    out = positional_split(tiny, SPEC, 0.8, strategy=strategy, chunk_rows=4)
    counts = {(r["city"], r["split"]): r["count"] for r in out.groupBy("city", "split").count().collect()}
    assert counts == {("A", "train"): 24, ("A", "test"): 6, ("B", "train"): 4, ("B", "test"): 1}


def test_chunked_handles_null_entity_and_time(spark):
    rows = [(c, t, k, float(k)) for k, (c, t) in enumerate(
        [("A", 1), ("A", None), (None, 2), (None, 1), ("A", 3), (None, None), ("A", 1), ("", 0), ("", None)] * 4)]
    df = spark.createDataFrame(rows, "city string, t int, k int, v double")
    cols = {"lag2": lambda w: F.lag("v", 2).over(w), "lead1": lambda w: F.lead("v", 1).over(w)}
    plain = add_window_columns(df, SPEC, cols, 2, 1, strategy="plain", rn_col="rn", size_col="n")
    chunked = add_window_columns(df, SPEC, cols, 2, 1, strategy="chunked", chunk_rows=3, rn_col="rn", size_col="n")
    pick = ["k", "lag2", "lead1", "rn", "n"]
    assert sorted(plain.select(*pick).collect()) == sorted(chunked.select(*pick).collect())


def _one_day(spark):
    ev = events_panel(spark, SF001)
    return ev.withColumns({"one": F.lit("x"), "day": F.lit("2024-01-01").cast("date"), "tie": F.when(F.col("event_id") % 7 > 0, F.col("event_type"))})


@pytest.mark.parametrize("ties", [("event_id",), ("tie", "event_id")])
def test_a_day_of_all_rows_is_cut(spark, ties):
    """One entity, one day holds every row: no unit that is ranked as a whole exceeds a chunk,
    and no task of the ranking reads more than a few."""
    day, spec = _one_day(spark), PanelSpec("one", "day", ties)
    cells, keys = position_cells(day, spec, 100)
    sizes = [r["count"] for r in cells.groupBy(*keys).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 100 and len(sizes) >= 10
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = with_positions(day, spec, "rn", "n", 100).withColumn("task", F.spark_partition_id())
        rows = out.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    per_task = Counter(r["task"] for r in rows)
    assert max(per_task.values()) <= 400 and len(per_task) > 5
    key = lambda r: tuple((r[c] is not None, r[c]) for c in ties)
    assert [r["rn"] for r in sorted(rows, key=key)] == list(range(1000)) and {r["n"] for r in rows} == {1000}


def test_cut_days_give_the_same_features(spark):
    day, spec = _one_day(spark), PanelSpec("one", "day", ("event_id",))
    both = events_panel(spark, SF001).withColumns({"one": F.when(F.col("event_id") % 5 > 0, F.lit("hot")), "day": F.to_date("ts")})
    for df, spec in ((day, spec), (both, PanelSpec("one", "day", ("ts", "event_id")))):
        plain = panel_features(df, spec, "value", strategy="plain")
        cut = panel_features(df, spec, "value", strategy="chunked", chunk_rows=25)
        cols = ["event_id", "value_target", "value_lag1", "value_lag24", "value_rolling_24"]
        rows = [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in out.select(*cols).collect()) for out in (plain, cut)]
        assert rows[0] == rows[1] and rows[0]
    assert position_cells(events_panel(spark, SF001), EVENTS_SPEC)[1] == ["_pc_ke", "_pc_ne", "_pc_kb", "_pc_nb"]  # no day that big


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_entities_within_a_chunk_take_one_exchange(spark):
    out = panel_features(events_panel(spark, SF001), EVENTS_SPEC, "value")
    assert _exchanges(out) == 1


def test_large_days_are_not_cut_by_an_array(spark):
    """No row carries the cuts of its day, which grow with the day."""
    day, spec = _one_day(spark), PanelSpec("one", "day", ("event_id",))
    cells, _ = position_cells(day, spec, 20)
    plan = cells._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "aggregate(" not in plan and "_pc_cuts" not in plan
    sizes = [r["count"] for r in cells.groupBy("_pc_part").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 20


@pytest.mark.parametrize("unit", [40, 300])
def test_large_and_small_entities_together(spark, monkeypatch, unit):
    """Some entities are ranked whole, some by days and ranges: the same columns as the plain plan."""
    monkeypatch.setattr("panelcast.operators.windows.DEFAULT_CHUNK_ROWS", unit)
    who = F.when(F.col("event_id") % 5 > 1, F.lit("hot")).when(F.col("event_id") % 5 > 0, F.concat(F.lit("u"), F.col("user_id") % 6))
    df = events_panel(spark, SF001).withColumns({"one": who, "day": F.to_date("ts")})
    spec = PanelSpec("one", "day", ("ts", "event_id"))
    cols = {"lead": lambda w: F.lead("value", 1).over(w), "lag": lambda w: F.lag("value", 24).over(w), "n24": lambda w: F.count("value").over(w.rowsBetween(-23, 0))}
    plans = [add_window_columns(df, spec, cols, 24, 1, strategy=s, chunk_rows=30, rn_col="rn", size_col="n") for s in ("plain", "chunked")]
    pick = ["event_id", "lead", "lag", "n24", "rn", "n"]
    rows = [sorted(map(tuple, p.select(*pick).collect())) for p in plans]
    assert rows[0] == rows[1] and len(rows[0]) == 1000
