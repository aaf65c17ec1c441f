"""Rows that meet the compact index of their shard in one pass.

Both sides are dealt by (shard, salt) and sorted so that a shard's index row comes right before the
rows that ask it. A task therefore holds one index at a time and streams through the rows, however
many there are; a shard that is asked often is split by salts, each with a copy of the index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def runs_of(*columns: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of each run of equal values."""
    n = len(columns[0])
    if not n:
        return []
    change = np.zeros(n - 1, bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    return list(zip(cuts[:-1], cuts[1:]))


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def asked(index: DataFrame, rows: DataFrame, schema: str, load: Callable[[bytes], object],
          answer: Callable[[object, pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``answer(index, rows)`` for the rows of each (shard, salt), batch by batch.

    ``index`` has shard, salt, blob (one row each); ``rows`` has shard, salt and what ``answer`` reads.
    Rows of a shard without an index row get None as index.
    """
    both = index.select("shard", "salt", "blob", F.lit(0).alias("_kind")).unionByName(
        rows.withColumn("_kind", F.lit(1)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]):
        held, current = None, None
        for batch in batches:
            shard, salt, kind = (_numbers(batch, c) for c in ("shard", "salt", "_kind"))
            blob = batch.column(batch.schema.get_field_index("blob"))
            for start, stop in runs_of(shard, salt, kind):
                if kind[start] == 0:
                    held, current = (shard[start], salt[start]), load(blob[start].as_py())
                    continue
                if held != (shard[start], salt[start]):
                    held, current = (shard[start], salt[start]), None
                yield answer(current, batch.slice(start, stop - start))

    return both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "_kind").mapInArrow(run, schema)


def grouped(rows: DataFrame, keys: list[str], schema: str,
            work: Callable[[tuple, list[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``work(key, batches)`` once for each key, over rows dealt and sorted by the keys. For groups
    whose bytes are bounded by how the keys were chosen; null keys are not allowed."""

    def run(batches: Iterator[pa.RecordBatch]):
        held, parts = None, []
        for batch in batches:
            columns = [_numbers(batch, k) for k in keys]
            for start, stop in runs_of(*columns):
                key = tuple(c[start] for c in columns)
                if parts and key != held:
                    yield from work(held, parts)
                    parts = []
                held = key
                parts.append(batch.slice(start, stop - start))
        if parts:
            yield from work(held, parts)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
