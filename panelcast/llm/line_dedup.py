"""Lines repeated across documents, found in a sharded minimal perfect hash.

Every line of at least ``points`` code points (ends stripped, A-Z lower-cased) is a 128-bit hash.
The distinct hashes are dealt to shards; each shard is a minimal perfect hash whose numbers index
flat arrays of fingerprints, document counts and largest holders. Documents probe these arrays:
lines themselves are never shuffled, sorted or joined. The few hashes that hold more than
1 / ``HOT_KEYS`` of all occurrences (so at most ``HOT_KEYS`` of them, whatever the input) form a
shard of their own that goes to every task and is probed in place; all others are probed where
their shard is, so no task sees more than that share of one line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from panelcast.llm.minimal_hash import MinimalHash, from_bytes, smallest_type, to_bytes
from panelcast.llm.routed import asked, grouped
from panelcast.llm.scratch import stored
from panelcast.llm.words import as_strings, chunks, give_back

POINTS = 20
LEAST_DOCS = 3
#: Keys of a shard on average: some 100 KB of arrays.
SHARD_KEYS = 16_384
HOT_KEYS = 10_000
BLANKS = " \t\n\x0b\x0c\r"
#: Stands for a null doc_id where ids are compared: below all others.
NO_ID = np.iinfo(np.int64).min


def line_hashes(texts: pa.Array, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """(first line of each text with one extra, 16 bytes a line as two unsigned numbers). Lines whose
    key has fewer than ``points`` code points are zeros."""
    lists = pc.split_pattern(texts, "\n")
    first = np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, lists.offset * 4).astype(np.int64)
    lines = lists.flatten()
    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=BLANKS))
    long_enough = np.flatnonzero(pc.utf8_length(keys).to_numpy(zero_copy_only=False) >= points)
    out = np.zeros((len(keys), 2), np.uint64)
    if len(long_enough):
        at = np.frombuffer(keys.buffers()[1], np.int32, len(keys) + 1, keys.offset * 4)
        data = memoryview(keys.buffers()[2])
        digest = xxhash.xxh3_128_digest
        made = b"".join([digest(data[a:b]) for a, b in zip(at[long_enough].tolist(), at[long_enough + 1].tolist())])
        out[long_enough] = np.frombuffer(made, "<u8").reshape(-1, 2)
    return first - first[0], out


def _text_keys(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    return {"_ld_t1": F.xxhash64(text), "_ld_t2": F.xxhash64(F.lit(12), text)}


def hashed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", points: int = POINTS) -> DataFrame:
    """(doc_id, _ld_t1, _ld_t2, lines): the hashes of each document's lines, and two hashes of its text."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                first, h = line_hashes(as_strings(part.column(3)), points)
                lines = pa.Array.from_buffers(pa.binary(), part.num_rows,
                                              [None, pa.py_buffer((first * 16).astype(np.int32)), pa.py_buffer(h)])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], lines], names=["doc_id", "_ld_t1", "_ld_t2", "lines"])

    made = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return made.withColumns(_text_keys(F.col("text"))).select("doc_id", "_ld_t1", "_ld_t2", "text").mapInArrow(
        run, "doc_id long, _ld_t1 long, _ld_t2 long, lines binary")


def _occurrences(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of a batch of hashed lines, sorted by (row, key): row, high, low, line, start of each (row, key)."""
    lines = batch.column(batch.schema.get_field_index("lines"))
    off = np.frombuffer(lines.buffers()[1], np.int32, len(lines) + 1, lines.offset * 4).astype(np.int64)
    data = lines.buffers()[2]
    h = np.frombuffer(data, np.uint64)[off[0] // 8:off[-1] // 8].reshape(-1, 2) if data is not None else np.zeros((0, 2), np.uint64)
    n = np.diff(off) // 16
    row = np.repeat(np.arange(len(n)), n)
    line = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    keep = np.flatnonzero((h[:, 0] != 0) | (h[:, 1] != 0))
    row, line, high, low = row[keep], line[keep], h[keep, 0], h[keep, 1]
    order = np.lexsort((line, low, high, row))
    row, line, high, low = row[order], line[order], high[order], low[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    return row, high, low, line, np.flatnonzero(new)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(batch.column(batch.schema.get_field_index("doc_id")), NO_ID).to_numpy(zero_copy_only=False)


def line_counts(hashed: DataFrame) -> DataFrame:
    """(high, low, n, last): documents that hold each distinct line, and the largest doc_id of them. Each
    batch is counted before the shuffle."""

    def run(batches):
        for batch in batches:
            row, high, low, _, start = _occurrences(batch)
            row, high, low = row[start], high[start], low[start]
            last = _ids(batch)[row]
            order = np.lexsort((low, high))
            high, low, last = high[order], low[order], last[order]
            new = np.ones(len(high), bool)
            new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
            at = np.flatnonzero(new)
            if len(at):
                n = np.diff(np.append(at, len(high)))
                yield pa.RecordBatch.from_arrays([pa.array(high[at].view(np.int64)), pa.array(low[at].view(np.int64)), pa.array(n),
                                                  pa.array(np.maximum.reduceat(last, at))], names=["high", "low", "n", "last"])
        give_back()

    counted = hashed.select("doc_id", "lines").mapInArrow(run, "high long, low long, n long, last long")
    return counted.groupBy("high", "low").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


class LineIndex:
    """A shard: minimal perfect hash, fingerprints, counts, and the largest holder of each line that
    at least ``least`` documents hold."""

    def __init__(self, **arrays: np.ndarray):
        self.arrays = arrays
        self.hash = MinimalHash(arrays["sizes"], arrays["words"])
        self.marks, self.counts, self.last = arrays["marks"], arrays["counts"], arrays["last"]
        self.repeated = self.counts >= arrays["least"][0]
        self.last_at = np.cumsum(self.repeated) - 1

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray, n: np.ndarray, last: np.ndarray, least: int) -> LineIndex:
        made = MinimalHash.of(high, low)
        at = made.numbers(high, low)
        marks, counts, ends = np.zeros(len(at), np.uint32), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        marks[at], counts[at], ends[at] = low.astype(np.uint32), n, last
        return cls(sizes=made.sizes, words=made.words, marks=marks, counts=smallest_type(counts),
                   last=ends[counts >= least], least=np.array([least]))

    def known(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Number of each key, -1 if it is not indexed (but for one in 2**32 keys of other texts)."""
        at = self.hash.numbers(high, low)
        if not len(self.marks):
            return at
        return np.where((at >= 0) & (self.marks[at] == low.astype(np.uint32)), at, -1)

    def loses(self, high: np.ndarray, low: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a document drops a line: enough documents hold it, one of them with a larger id."""
        at = self.known(high, low)
        out = np.zeros(len(at), bool)
        some = np.flatnonzero(at >= 0)
        some = some[self.repeated[at[some]]]
        out[some] = doc[some] < self.last[self.last_at[at[some]]]
        return out

    def dump(self) -> bytes:
        return to_bytes(**self.arrays)

    @classmethod
    def load(cls, blob: bytes) -> LineIndex:
        return cls(**from_bytes(blob))


def line_index(counts: DataFrame, shards: int, least: int = LEAST_DOCS) -> DataFrame:
    """(shard, salt, blob): one row of arrays per shard of the distinct line hashes."""

    def build(key, parts):
        columns = [np.concatenate([p.column(p.schema.get_field_index(c)).to_numpy() for p in parts]) for c in ("high", "low", "n", "last")]
        index = LineIndex.of(columns[0].view(np.uint64), columns[1].view(np.uint64), columns[2], columns[3], least)
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([0], pa.int32()), pa.array([index.dump()], pa.binary())],
                                         names=["shard", "salt", "blob"])

    dealt = counts.select(F.pmod("high", F.lit(shards)).cast("int").alias("shard"), "high", "low", "n", "last")
    return grouped(dealt, ["shard"], "shard int, salt int, blob binary", build)


def _line_lists(line: np.ndarray, start: np.ndarray, total: int) -> pa.Array:
    """Binary array of the 32-bit line numbers from each start to the next."""
    ends = np.append(start, total).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends * np.int32(4)), pa.py_buffer(line.astype(np.int32))])


_DROPS = "doc_id long, _ld_t1 long, _ld_t2 long, lines binary"


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", points: int = POINTS,
                  least: int = LEAST_DOCS, shard_keys: int = SHARD_KEYS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """(doc_id, _ld_t1, _ld_t2, drops): for each text that loses lines, binary lists of 32-bit line numbers."""
    hashed = stored(hashed_lines(docs, doc_id, text, points), "line-hashes")
    counts = stored(line_counts(hashed), "line-counts")
    distinct, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = counts.filter(F.col("n") * hot_keys > total)
    rows = hot.collect()  # at most hot_keys rows: each holds more than 1 / hot_keys of the total
    columns = np.array([tuple(r) for r in rows], np.int64).reshape(-1, 4)
    own = LineIndex.of(columns[:, 0].copy().view(np.uint64), columns[:, 1].copy().view(np.uint64), columns[:, 2], columns[:, 3], least).dump()
    shards = max(1, -(-(distinct - len(rows)) // shard_keys))

    def in_place(batches):
        index = LineIndex.load(own)
        for batch in batches:
            row, high, low, line, start = _occurrences(batch)
            lose = index.loses(high[start], low[start], _ids(batch)[row[start]])
            if lose.any():
                lists = _line_lists(line, start, len(line)).filter(pa.array(lose))
                at = pa.array(row[start][lose])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), lists], names=["doc_id", "_ld_t1", "_ld_t2", "lines"])

    def others(batches):
        index = LineIndex.load(own)
        for batch in batches:
            row, high, low, line, start = _occurrences(batch)
            cold = index.known(high[start], low[start]) < 0
            if cold.any():
                lists, at, mine = _line_lists(line, start, len(line)).filter(pa.array(cold)), pa.array(row[start][cold]), start[cold]
                shard = high[mine].view(np.int64) % np.int64(shards)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(at) for i in range(3)), lists, pa.array(shard.astype(np.int32)), pa.array(np.zeros(len(mine), np.int32)),
                     pa.array(high[mine].view(np.int64)), pa.array(low[mine].view(np.int64))],
                    names=["doc_id", "_ld_t1", "_ld_t2", "lines", "shard", "salt", "high", "low"])

    def answer(index, batch):
        columns = {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "_ld_t1", "_ld_t2", "lines", "high", "low")}
        lose = index.loses(columns["high"].to_numpy().view(np.uint64), columns["low"].to_numpy().view(np.uint64), _ids(batch))
        return pa.RecordBatch.from_arrays([columns[c] for c in ("doc_id", "_ld_t1", "_ld_t2", "lines")], names=["doc_id", "_ld_t1", "_ld_t2", "lines"]).filter(pa.array(lose))

    found = hashed.mapInArrow(in_place, _DROPS)
    if distinct > len(rows):
        cold = counts.filter(F.col("n") * hot_keys <= total)
        probes = hashed.mapInArrow(others, _DROPS + ", shard int, salt int, high long, low long")
        found = found.union(asked(line_index(cold, shards, least), probes, _DROPS, LineIndex.load, answer))
    return found.groupBy("doc_id", "_ld_t1", "_ld_t2").agg(F.collect_set("lines").alias("drops"))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", points: int = POINTS,
                        least: int = LEAST_DOCS, shard_keys: int = SHARD_KEYS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``docs`` with the text rid of repeated lines, n_lines (before) and n_dropped.

    A line whose key at least ``least`` documents hold is dropped everywhere but in the largest doc_id
    holding it, which keeps all its lines of that key; what is left is joined by newlines. Every row is
    a document: rows with the same id count each, and all rows of a key's largest id keep it. A null id
    is below all others. Null and empty texts are one empty line and become empty texts, lines of
    blanks and short lines always stay, a text without a kept line becomes empty. Columns named n_lines
    or n_dropped are replaced, all others pass through; an empty table gives no rows.
    """
    drops = dropped_lines(docs, doc_id, text, points, least, shard_keys, hot_keys).select(
        F.col("doc_id").alias("_ld_id"), F.col("_ld_t1").alias("_ld_d1"), F.col("_ld_t2").alias("_ld_d2"), F.col("drops").alias("_ld_drops"))
    kept = docs.drop("n_lines", "n_dropped").withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))
    keyed = kept.withColumns(_text_keys(F.col(text)))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_ld_id")) & (F.col("_ld_t1") == F.col("_ld_d1")) & (F.col("_ld_t2") == F.col("_ld_d2"))
    joined = keyed.join(drops, same, "left").select(*[F.col(f"`{c}`") for c in kept.columns], "_ld_drops")
    schema = StructType([*kept.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    place, names = kept.columns.index(text), [*kept.columns, "n_lines", "n_dropped"]

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                texts, lists = as_strings(part.column(place)), part.column(part.num_columns - 1)
                n_lines = pc.add(pc.count_substring(texts, "\n").cast(pa.int64()), 1)
                n_dropped = np.zeros(part.num_rows, np.int64)
                some = np.flatnonzero(pc.is_valid(lists).to_numpy(zero_copy_only=False))
                if len(some):
                    new = texts.to_pylist()
                    for i in some.tolist():
                        gone = set(np.frombuffer(b"".join(lists[i].as_py()), np.int32).tolist())
                        new[i] = "\n".join([x for k, x in enumerate(new[i].split("\n")) if k not in gone])
                        n_dropped[i] = len(gone)
                    texts = pa.array(new, pa.string())
                columns = [*part.columns[:-1], n_lines, pa.array(n_dropped)]
                columns[place] = texts
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, schema)
