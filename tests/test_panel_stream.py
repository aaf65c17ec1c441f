"""The stateful stream of panel features equals the batch windows."""

import pytest
from pyspark.sql import functions as F

from panelcast.operators.features import panel_features
from panelcast.panel import PanelSpec
from panelcast.session import scratch_path
from panelcast.sources.adapters import EVENTS_SPEC, events_panel
from panelcast.streaming.panel import ROCKSDB, panel_feature_stream

from conftest import SF001

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    yield
    spark.conf.set(PROVIDER, before)


def _stream(spark, batches, spec, col, delay, **kw):
    """Rows of a stream whose micro-batches are the given DataFrames, in turn."""
    src, ckpt, out = (scratch_path(spark, n) for n in ("stream-in", "stream-state", "stream-out"))
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(src)
    made = panel_feature_stream(stream, spec, col, delay, **kw)
    q = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.read.schema(made.schema).parquet(out), q


def _rows(df, cols):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())


def test_micro_batches_with_late_rows_equal_the_batch(spark, rocksdb):
    ev = events_panel(spark, SF001).select("user_id", "ts", "event_id", "value")
    # arrival up to a day after the event: every batch has rows that belong before rows of the last one
    late = F.pmod(F.xxhash64("event_id"), F.lit(86_400))
    arrival = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) + late) / (6 * 86_400))
    ev = ev.withColumn("arrival", arrival)
    parts = [r[0] for r in ev.select("arrival").distinct().orderBy("arrival").collect()]
    batches = [ev.filter(F.col("arrival") == p).drop("arrival") for p in parts]
    assert len(batches) >= 4
    last = spark.createDataFrame([(-1, 0)], "user_id long, event_id long").select(
        "user_id", F.lit("2100-01-01").cast("timestamp_ntz").alias("ts"), "event_id", F.lit(0.0).alias("value"))
    got, _ = _stream(spark, [*batches, last], EVENTS_SPEC, "value", "1 day")
    cols = ["event_id", "user_id", "ts", "value", "value_target", "value_lag1", "value_lag24", "value_rolling_24"]
    want = _rows(panel_features(ev, EVENTS_SPEC, "value"), cols)
    assert _rows(got, cols) == want and len(want) > 900


def test_nulls_and_too_late_rows(spark, rocksdb):
    schema = "e string, t timestamp, k string, v double"
    first = [("A", "2024-01-01 00:00:00", "b", 1.0), ("A", "2024-01-01 00:00:00", None, None), ("A", "2024-01-03 00:00:00", "a", 3.0),
             (None, "2024-01-01 00:00:00", "a", 9.0), ("A", None, "a", 9.0), ("B", "2024-01-09 00:00:00", "a", 0.0)]
    second = [("A", "2024-01-08 12:00:00", "in time", 8.0), ("A", "2024-01-10 00:00:00", "z", 10.0), ("C", "2024-03-01 00:00:00", "z", 0.0)]
    third = [("A", "2024-01-02 00:00:00", "too late", 2.0), ("C", "2024-03-02 00:00:00", "z", 0.0)]
    made = [spark.createDataFrame([(e, t, k, v) for e, t, k, v in b], "e string, t string, k string, v double").withColumn("t", F.col("t").cast("timestamp")) for b in (first, second, third)]
    assert made[0].schema.simpleString() == "struct<" + schema.replace(", ", ",").replace(" ", ":") + ">"
    got, _ = _stream(spark, made, PanelSpec("e", "t", ("k",)), "v", "1 day", lags=(1, 2), rolling=(2,))
    rows = [(r["e"], r["k"], r["v"], r["v_target"], r["v_lag1"], r["v_lag2"], r["v_rolling_2"]) for r in got.orderBy("e", "t", "k").collect()]
    assert rows == [("A", None, None, 1.0, None, None, None), ("A", "b", 1.0, 3.0, None, None, 1.0),
                    ("A", "a", 3.0, 8.0, 1.0, None, 2.0), ("A", "in time", 8.0, 10.0, 3.0, 1.0, 5.5)]


def test_needs_the_timer_store(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(RuntimeError, match="RocksDB"):
            panel_feature_stream(events_panel(spark, SF001), EVENTS_SPEC, "value", "1 day")
    finally:
        spark.conf.set(PROVIDER, before)


def test_entities_share_a_bucket_and_calls(spark, rocksdb):
    """One bucket holds all entities, several of which get rows in one call and some in none; values and ties may be null."""
    rows = [(f"e{i % 7}", f"2024-01-{1 + (i * 5) % 20:02d} 00:00:{i % 60:02d}", i if i % 9 else None, float(i * i % 17) if i % 5 else None) for i in range(400)]
    rows = list({r[:3]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "e string, t string, k long, v double").withColumn("t", F.col("t").cast("timestamp"))
    cut = ["2024-01-01", "2024-01-05", "2024-01-09", "2024-01-21"]
    parts = [df.filter(F.col("t").between(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp"))) for a, b in zip(cut, cut[1:])]
    last = spark.createDataFrame([("end", 0, 0.0)], "e string, k long, v double").select("e", F.lit("2100-01-01").cast("timestamp").alias("t"), "k", "v")
    spec = PanelSpec("e", "t", ("k",))
    cols = ["e", "t", "k", "v", "v_target", "v_lag1", "v_lag24", "v_rolling_24"]
    want = panel_features(df, spec, "v")
    key = lambda rs: sorted(rs, key=repr)
    for buckets in (1, 3):
        got, _ = _stream(spark, [*parts, last], spec, "v", "1 hour", buckets=buckets)
        assert key(_rows_any(got, cols)) == key(_rows_any(want, cols)) and want.count() > 200


def _rows_any(df, cols):
    return [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect()]


def test_a_state_serves_many_entities(spark, rocksdb):
    """The stream is grouped by bucket, not by entity: calls and states do not grow with the entities."""
    src = scratch_path(spark, "plan-in")
    ev = events_panel(spark, SF001).select("user_id", "ts", "event_id", "value")
    ev.limit(1).write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    plan = panel_feature_stream(stream, EVENTS_SPEC, "value", "1 day")._jdf.queryExecution().logical().toString()
    assert "pc_bucket" in plan


def test_files_a_batch():
    from __spark_entry__ import _files_a_batch
    assert _files_a_batch([]) == 1 and _files_a_batch([5, 100]) == 1
    assert _files_a_batch([7_200_000, 1_200_000]) == 8
    assert _files_a_batch([7_200_000, 20_000]) == 2
