"""Lead, lag and rolling features of a panel on a stream (stateful).

Readings of an entity may arrive in any order within the watermark's delay. Entities are dealt by hash to a fixed number
of buckets and a bucket is one state, so that the cost of a call and of a state's round trip is shared by all its entities. The
state of a bucket is what has arrived but may still be preceded by something late, and of each entity the last rows already in
order, as far back as the features look; both are Arrow tables. When the watermark passes a reading it is final: it takes its
place behind the earlier ones of its entity, gets its lags and rolling means, and is put out once its successor (the target) is
final too. The rows put out are those of the batch windows over the same readings; an entity's last reading has no target and
is held, as it is dropped there. The state lives in the RocksDB store, checkpointed with the query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType, LongType, StructField, StructType

from panelcast.operators.features import lag_name, rolling_name, target_name
from panelcast.panel import PanelSpec

#: States of a stream: a call holds a bucket's waiting and last rows. Fixed for the life of a checkpoint.
BUCKETS = 256
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def panel_feature_stream(stream: DataFrame, spec: PanelSpec, col: str, delay: str, lags: Sequence[int] = (1, 24),
                         rolling: Sequence[int] = (24,), buckets: int = BUCKETS) -> DataFrame:
    """(entity, time, tie-breakers, col, target, lags, rolling means) in append mode.

    Same features as ``panel_features`` in row mode with a horizon of one row. ``delay`` is the watermark's: what arrives
    later than that behind the newest reading of the whole stream (as of the batch before) is dropped. Readings without a time or an entity are left
    out (they have no place in time); null values stay rows, as in the batch windows, and rows without a
    target are not put out. Times must lie in the years 1678 to
    2261 (pandas holds nanoseconds). Tie-breakers must be numbers or text and, with the time, unique within an entity.
    ``buckets`` is part of the checkpoint; a task holds one bucket, so a wider panel asks for more.
    """
    session = stream.sparkSession
    if session.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        raise RuntimeError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}: the state has timers")
    ties, look = list(spec.tie_breakers), max([*lags, *(n - 1 for n in rolling), 1])
    order = [StructField("_us", LongType()), *[stream.schema[t] for t in ties]]
    held = StructType([*order, StructField(col, DoubleType())])
    made = [target_name(col), *[lag_name(col, k) for k in lags], *[rolling_name(col, n) for n in rolling]]
    out = StructType([stream.schema[spec.entity], *held.fields, *[StructField(n, DoubleType()) for n in made]])
    entity = spec.entity
    whole = [t for t in ties if isinstance(stream.schema[t].dataType, IntegralType)]
    arriving = ["pc_bucket", entity, *ties, col, "_at", "_us"]
    processor = _processor(entity, arriving, [entity, *[f.name for f in held.fields]], col, whole, tuple(lags), tuple(rolling), look, made)
    at = F.col(spec.time).cast("timestamp")
    rows = (stream.filter(F.col(spec.time).isNotNull() & F.col(entity).isNotNull())
            .select(F.pmod(F.xxhash64(entity), F.lit(buckets)).alias("pc_bucket"), entity, *ties, F.col(col).cast("double").alias(col),
                    at.alias("_at"), F.unix_micros(at).alias("_us"))
            .withWatermark("_at", delay))
    found = rows.groupBy("pc_bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")
    return found.withColumn(spec.time, F.timestamp_micros("_us").cast(stream.schema[spec.time].dataType)).select(entity, *spec.order_cols, col, *made)


def _processor(entity: str, arriving: list[str], columns: list[str], col: str, whole: list[str], lags: tuple, rolling: tuple, look: int, made: list[str]):
    """Defined here, so that executors get it by value and need not have the package."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    from pyspark.sql.streaming import StatefulProcessor

    def typed(frame):
        """Nullable integers stay integers, a missing value is NaN."""
        return frame.astype({**{t: "Int64" for t in whole}, "_us": "int64", col: "float64"})

    def means(values, first, at, n):
        """Means of the rows ``at`` and the n - 1 before them, back to their entity's first; missing values don't count."""
        out = np.empty(len(at))
        for a in range(0, len(at), 1 << 15):
            some = at[a:a + (1 << 15)]
            back = some[:, None] - np.arange(n)[::-1]
            seen = values[np.maximum(back, 0)]
            has = (back >= first[some][:, None]) & ~np.isnan(seen)
            total, count = np.where(has, seen, 0.0).sum(axis=1), has.sum(axis=1)
            out[a:a + len(some)] = np.where(count, total / np.maximum(count, 1), np.nan)
        return out

    class Panel(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.waiting = handle.getValueState("waiting", "rows binary")  # may still be preceded
            self.placed = handle.getValueState("placed", "rows binary")    # the last rows of each entity, in order; its last is not put out yet

        def load(self, state):
            found = state.get() if state.exists() else None
            return None if found is None else typed(pa.ipc.open_stream(bytes(found[0])).read_pandas())

        def save(self, state, frame):
            table = pa.Table.from_pandas(frame, preserve_index=False).replace_schema_metadata()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
                writer.write_table(table)
            state.update((sink.getvalue().to_pybytes(),))

        def handleInputRows(self, key, rows, timerValues):
            came = []
            for frame in rows:
                frame.columns = arriving  # names that start with an underscore do not arrive
                came.append(typed(frame[columns]))
            yield from self.settled(timerValues, came)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            yield from self.settled(timerValues, [])

        def settled(self, timerValues, came):
            passed = timerValues.getCurrentWatermarkInMs()
            held = self.load(self.waiting)
            parts = [p for p in (held, *came) if p is not None]
            if not parts:
                return
            rows = pd.concat(parts, ignore_index=True)
            final = (rows["_us"] // 1000 <= passed).to_numpy()
            if final.any() and final.all():
                self.waiting.clear()
            elif came or final.any():
                rest = rows[~final]
                self.save(self.waiting, rest)
                self.handle.registerTimer(int(rest["_us"].min()) // 1000 + 1)
            if final.any():
                yield from self.put_out(rows[final])

        def put_out(self, final):
            final = final.sort_values(columns[1:-1], kind="stable", na_position="first")
            before = self.load(self.placed)
            old = 0 if before is None else len(before)
            rows = final if before is None else pd.concat([before, final], ignore_index=True)
            code = pd.factorize(rows[entity])[0]
            turn = np.argsort(code, kind="stable")  # the placed rows of an entity stay before its new ones
            rows, code = rows.iloc[turn].reset_index(drop=True), code[turn]
            size = np.bincount(code)
            first = np.repeat(np.cumsum(size) - size, size)
            place, size = np.arange(len(rows)) - first, np.repeat(size, size)
            known = np.bincount(code[turn < old], minlength=int(code[-1]) + 1)[code]
            self.save(self.placed, rows[size - place <= look + 1])
            values = rows[col].to_numpy()
            at = np.flatnonzero((place >= known - 1) & (place < size - 1))
            at = at[~np.isnan(values[at + 1])]
            if not len(at):
                return
            ready = rows.iloc[at].reset_index(drop=True)
            ready[made[0]] = values[at + 1]
            for name, k in zip(made[1:], lags):
                ready[name] = np.where(place[at] >= k, values[np.maximum(at - k, 0)], np.nan)
            for name, n in zip(made[1 + len(lags):], rolling):
                # a sum of the frame itself, not a running one: no rounding is carried on
                ready[name] = means(values, first, at, n)
            yield ready

        def close(self):
            pass

    return Panel()
