"""Arrow-batch helpers shared by the text operators.

A batch of texts is split once into words by Arrow; each distinct word of the
batch is handled once and its result gathered back by code, so the cost per
word occurrence is a dictionary lookup in C++.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

CHUNK_BYTES = 2 << 20
LONG_WORD = 256

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def crc_mod(column: str, m: int) -> Column:
    """crc32 of the column as text, modulo ``m`` (a null counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_strings(column: pa.Array) -> pa.Array:
    """The texts with null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def _layout(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array, from zero."""
    off = np.frombuffer(arr.buffers()[1], np.int32, len(arr) + 1, arr.offset * 4).astype(np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return off - off[0], data[off[0]:off[-1]]


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hash of each string: a polynomial over random byte values, taken
    from prefix sums of the whole buffer; strings over 256 bytes use xxh3."""
    if not len(words):
        return np.zeros(0, np.uint64)
    off, data = _layout(words)
    powers = np.full(len(data) + 1, _R, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[:-1], out=sums[1:])
    back = np.full(len(data) + 1, _R_INV, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    length = np.diff(off).astype(np.uint64)
    h = mix64((sums[off[1:]] - sums[off[:-1]]) * back[off[:-1]] + mix64(length + np.uint64(77)))
    for i in np.flatnonzero(length > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(words[int(i)].as_py().encode())
    return h


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: (code of each word, first word
    of each text with one extra, distinct words)."""
    lists = pc.ascii_split_whitespace(texts)
    off = np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, lists.offset * 4).astype(np.int64)
    values = lists.flatten()
    off = off - off[0]
    full = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0
    before = np.zeros(len(full) + 1, np.int64)
    np.cumsum(full, out=before[1:])
    coded = values.filter(pa.array(full)).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), before[off], coded.dictionary


def letter_words(texts: pa.Array, digits: bool = False) -> pa.Array:
    """Lower-cased texts with every run of other characters than letters (and
    digits, if asked) as one blank."""
    return pc.utf8_lower(pc.replace_substring_regex(texts, r"[^\pL\pM\pN]+" if digits else r"[^\pL\pM]+", " "))


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``values`` (one per word) of each text."""
    total = np.zeros((len(first) - 1, *values.shape[1:]))
    some = np.flatnonzero(np.diff(first))
    if len(some):
        total[some] = np.add.reduceat(values, first[some], axis=0, dtype=np.float64)
    return total


def max_by_text(values: np.ndarray, first: np.ndarray, empty: float) -> np.ndarray:
    """Largest of the words' values of each text."""
    most = np.full(len(first) - 1, empty)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        most[some] = np.maximum.reduceat(values, first[some])
    return most


class WordCache:
    """What was worked out for a word, by its hash; sorted keys and value rows
    in plain arrays. Emptied when it holds ``limit`` words."""

    def __init__(self, limit: int):
        self.limit, self.keys, self.at, self.values = limit, np.zeros(0, np.uint64), np.zeros(0, np.int64), None

    def rows(self, words: pa.Array, work: Callable[[list[str]], np.ndarray]) -> np.ndarray:
        """One value row per distinct word; ``work`` gets the words not yet known."""
        h = hash_words(words)
        if self.values is None or len(self.keys) + len(h) > self.limit:
            self.keys, self.at, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64), None
        spot = np.searchsorted(self.keys, h)
        known = np.zeros(len(h), bool)
        if len(self.keys):
            known = self.keys[np.minimum(spot, len(self.keys) - 1)] == h
        if not known.all():
            new = np.flatnonzero(~known)
            made = work(words.take(pa.array(new)).to_pylist())
            start = 0 if self.values is None else len(self.values)
            self.values = made if self.values is None else np.concatenate([self.values, made])
            order = np.argsort(h[new])
            put = np.searchsorted(self.keys, h[new][order])
            self.keys = np.insert(self.keys, put, h[new][order])
            self.at = np.insert(self.at, put, start + order)
            spot = np.searchsorted(self.keys, h)
        return self.values[self.at[spot]] if len(h) else np.zeros(0)


def give_back() -> None:
    """Return what the last batch used to the system: an idle Python worker keeps its memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of ``column``, whole rows each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def with_columns(df: DataFrame, text: str, fields: Sequence[StructField],
                 work: Callable[[pa.Array], Sequence[pa.Array]]) -> DataFrame:
    """``df`` with ``fields`` worked out from the texts, batch by batch. Columns
    of the same names are replaced; all others pass through."""
    names = [f.name for f in fields]
    kept = df.drop(*names)
    schema = StructType([*kept.schema.fields, *fields])

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                made = work(as_strings(part.column(part.schema.get_field_index(text))))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])

    return kept.mapInArrow(run, schema)
