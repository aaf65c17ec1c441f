"""Benchmark decontamination by a BM25 inverted index of the test items.

Every document is cut into overlapping passages; every passage queries the index with
block-max WAND and all items whose BM25 score reaches their threshold are retrieved
(no top-k). Long items are indexed in units; a retrieved unit only says where to look for
its item. The item counts if its whole question and its whole answer are both around that
passage: at least OVERLAP of the five-word shingles of either part. An item without an
answer is verified as one text; a part of fewer than five words must occur whole.

Thresholds are a share of an item's own score, so postings are stored divided by
them and a passage retrieves what reaches 1. Passages run over whole texts; the scan is map-only.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from panelcast.llm.scratch import stored
from panelcast.llm.words import hash_words, letter_words, mix64, split_words, with_columns

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that retrieves it.
THRESHOLD = 0.6
OVERLAP, SHINGLE = 0.8, 5
#: Items are indexed in units of at most this many words; passages hold any unit whole.
UNIT_WORDS = 64
PASSAGE_WORDS, STEP = 2 * UNIT_WORDS, UNIT_WORDS
#: Units a block of the index: the postings of a term in units [4k, 4k + 4) are a block.
BLOCK = 4
#: Items are indexed at once up to about this many bytes of text; more are queried index by index.
INDEX_BYTES = 32 << 20

_MUL = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(h: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the ``width``-word shingles of hashed words (of all words, if fewer)."""
    width = min(width, len(h))
    if not width:
        return np.zeros(0, np.uint64)
    x = h[:len(h) - width + 1].copy()
    for k in range(1, width):
        x = mix64(x * _MUL + h[k:len(h) - width + 1 + k])
    return x


@dataclass(eq=False)
class Item:
    """A row of the benchmark: its whole question's and answer's shingles."""

    id: int
    question: np.ndarray
    answer: np.ndarray


@dataclass
class Unit:
    """A stretch of an item, with the number of the item's words before and after it."""

    item: Item
    before: int
    after: int


class Index:
    """Postings by term: unit numbers ascending, scores as a share of the unit's threshold, block maxima."""

    def __init__(self, units: list[Unit], terms: np.ndarray, unit_of: np.ndarray, tf: np.ndarray, df: np.ndarray,
                 lengths: np.ndarray, n_units: int, mean_length: float):
        self.units = units
        idf = np.log1p((n_units - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths[unit_of] / mean_length)
        score = idf * tf * (K1 + 1) / (tf + norm)
        own = np.bincount(unit_of, score, len(units))
        share = score / (THRESHOLD * own[unit_of])
        order = np.lexsort((unit_of, terms))
        terms, self.unit, self.share = terms[order], unit_of[order], share[order]
        self.terms, first = np.unique(terms, return_index=True)
        self.first = np.append(first, len(terms))
        self.most = np.maximum.reduceat(self.share, first) if len(first) else np.zeros(0)
        # block postings of each term: block numbers ascending, the largest share within
        block = self.unit // BLOCK
        new = np.ones(len(terms), bool)
        new[1:] = (block[1:] != block[:-1]) | (terms[1:] != terms[:-1])
        at = np.flatnonzero(new)
        self.block = block[at]
        self.block_most = np.maximum.reduceat(self.share, at) if len(at) else np.zeros(0)
        self.block_first = np.append(np.searchsorted(at, first), len(at)) if len(first) else np.zeros(1, np.int64)
        self.n_blocks = -(-len(units) // BLOCK)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Term number of each hashed word, -1 for words not in the index."""
        if not len(self.terms):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def retrieve(self, query: np.ndarray) -> list[tuple[int, float]]:
        """(unit, score) of all units that reach 1, by block-max WAND over the distinct terms of a passage."""
        at = {int(t): int(self.first[t]) for t in query}
        end = {int(t): int(self.first[t + 1]) for t in query}
        found = []
        while True:
            live = sorted((t for t in at if at[t] < end[t]), key=lambda t: self.unit[at[t]])
            # pivot: the first unit that the lists' maxima so far can carry over the threshold
            bound, pivot = 0.0, None
            for k, t in enumerate(live):
                bound += self.most[t]
                if bound >= 1:
                    pivot = k
                    break
            if pivot is None:
                return found
            unit = self.unit[at[live[pivot]]]
            while pivot + 1 < len(live) and self.unit[at[live[pivot + 1]]] == unit:
                pivot += 1
            # the same bound with the maxima of the block that holds the unit
            blocks = 0.0
            for t in live[:pivot + 1]:
                lo, hi = int(self.block_first[t]), int(self.block_first[t + 1])
                b = lo + int(np.searchsorted(self.block[lo:hi], unit // BLOCK))
                if b < hi and self.block[b] == unit // BLOCK:
                    blocks += self.block_most[b]
            if blocks < 1:
                # no unit of this block (up to the next list's unit) can reach it
                target = (unit // BLOCK + 1) * BLOCK
                if pivot + 1 < len(live):
                    target = min(target, self.unit[at[live[pivot + 1]]])
                target = max(target, unit + 1)
                for t in live[:pivot + 1]:
                    at[t] += int(np.searchsorted(self.unit[at[t]:end[t]], target))
            elif self.unit[at[live[0]]] == unit:
                score = sum(self.share[at[t]] for t in live[:pivot + 1])
                if score >= 1:
                    found.append((int(unit), float(score)))
                for t in live[:pivot + 1]:
                    at[t] += 1
            else:
                for t in live[:pivot + 1]:
                    if self.unit[at[t]] < unit:
                        at[t] += int(np.searchsorted(self.unit[at[t]:end[t]], unit))

    def search(self, texts: pa.Array) -> list[list[tuple[int, float, float | None, float | None]]]:
        """Per text the verified (item, BM25 share, question overlap, answer overlap); None for an empty part."""
        codes, first, distinct = split_words(letter_words(texts, digits=True))
        h = hash_words(distinct)
        number = np.append(self.numbers(h), -1)
        hits: list[dict[int, tuple[float, float | None, float | None]]] = [{} for _ in range(len(first) - 1)]
        for doc, passages in groupby(self._passages(number, codes, first), key=lambda p: p[0]):
            # per item the words in which it is looked for: the passage of a unit, the item's words before and after
            # the unit (as many again may be inserted) and the neighbouring passages
            spots: dict[Item, list[tuple[int, int, float]]] = {}
            start, n = int(first[doc]), int(first[doc + 1] - first[doc])
            for _, a, b in passages:
                terms = np.unique(number[codes[a:b]])
                for u, score in self.retrieve(terms[terms >= 0]):
                    unit = self.units[u]
                    spots.setdefault(unit.item, []).append((max(0, a - start - STEP - 2 * unit.before), min(n, b - start + STEP + 2 * unit.after), score))
            words, made = h[codes[start:start + n]], {}
            for item, where in spots.items():
                overlaps = zip(*(_overlaps(part, words, where, made) for part in (item.question, item.answer)))
                for (_, _, score), (q, w) in zip(where, overlaps):
                    if min(x for x in (q, w, 1.0) if x is not None) >= OVERLAP and (item.id not in hits[doc] or hits[doc][item.id][0] < score):
                        hits[doc][item.id] = (score, q, w)
        return [[(k, *v) for k, v in sorted(found.items())] for found in hits]

    def _passages(self, number: np.ndarray, codes: np.ndarray, first: np.ndarray):
        """(text, first word, last word + 1) of the passages that may retrieve something: the two bounds of block-max WAND,
        list maxima and then block maxima of the distinct terms, for many passages at once."""
        n = np.diff(first)
        per_text = np.maximum(1, -(-(n - STEP) // STEP))
        text = np.repeat(np.arange(len(n)), per_text)
        start = first[text] + STEP * (np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text))
        stop = np.minimum(start + PASSAGE_WORDS, first[text + 1])
        padded = np.append(codes, len(number) - 1)
        most = np.append(self.most, 0.0)
        for at in range(0, len(text), 2048):
            a, b = start[at:at + 2048], stop[at:at + 2048]
            where = a[:, None] + np.arange(PASSAGE_WORDS)
            rows = np.sort(number[padded[np.where(where < b[:, None], where, len(codes))]], axis=1)
            once = rows >= 0
            once[:, 1:] &= rows[:, 1:] != rows[:, :-1]
            some = np.flatnonzero((most[rows] * once).sum(axis=1) >= 1)
            if not len(some):
                continue
            r, k = np.nonzero(once[some])
            terms = rows[some[r], k]
            lo, size = self.block_first[terms], self.block_first[terms + 1] - self.block_first[terms]
            upto = np.cumsum(size)
            lists = np.repeat(lo - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)
            cell = np.repeat(r, size) * self.n_blocks + self.block[lists]
            if len(some) * self.n_blocks <= 1 << 22:
                bound = np.bincount(cell, self.block_most[lists], len(some) * self.n_blocks).reshape(len(some), -1).max(axis=1, initial=0)
            else:  # many blocks: only the cells met
                cells, back = np.unique(cell, return_inverse=True)
                bound = np.zeros(len(some))
                np.maximum.at(bound, cells // self.n_blocks, np.bincount(back, self.block_most[lists]))
            for i in some[bound >= 1 - 1e-9]:
                yield int(text[at + i]), int(a[i]), int(b[i])


def _overlaps(part: np.ndarray, words: np.ndarray, where: list[tuple[int, int, float]], made: dict) -> list[float | None]:
    """Share of a part's shingles in each stretch [lo, hi) of a text's words; None for an empty part."""
    hashes, width = part[1:], int(part[0])
    if not len(hashes):
        return [None] * len(where)
    if width not in made:
        made[width] = shingle_hashes(words, width) if len(words) >= width else np.zeros(0, np.uint64)
    least = min(lo for lo, _, _ in where)
    text = made[width][least:max(hi for _, hi, _ in where) - width + 1]
    no = np.minimum(np.searchsorted(hashes, text), len(hashes) - 1)
    at = np.flatnonzero(hashes[no] == text)
    no, at = no[at], at + least
    return [len(np.unique(no[np.searchsorted(at, lo):np.searchsorted(at, hi - width, "right")])) / len(hashes) for lo, hi, _ in where]


def _part(h: np.ndarray) -> np.ndarray:
    """Shingle width, then the distinct shingles, of a question or answer."""
    return np.concatenate([np.array([min(SHINGLE, len(h))], np.uint64), np.unique(shingle_hashes(h))])


def units_of(items: list[tuple[int, str, str | None]]) -> tuple[list[Unit], list[np.ndarray]]:
    """Units of (item, question, answer) and their word hashes. Without an answer the
    question is the whole item. A part of fewer than SHINGLE words is one shingle; items without a word give no unit."""
    units, words = [], []
    for item, question, answer in items:
        lists = [split_words(letter_words(pa.array([x or ""], pa.string()), digits=True)) for x in (question, answer)]
        q, a = (hash_words(d)[c] for c, _, d in lists)
        whole = np.concatenate([q, a])
        if not len(whole):
            continue
        row, at = Item(item, _part(q), _part(a)), 0
        for part in np.array_split(whole, -(-len(whole) // UNIT_WORDS)):
            units.append(Unit(row, at, len(whole) - at - len(part)))
            words.append(part)
            at += len(part)
    return units, words


def build_indexes(benchmark: DataFrame, item_id: str = "item_id", question: str = "text", answer: str | None = None,
                  index_bytes: int = INDEX_BYTES) -> list[Index]:
    """One index per ``index_bytes`` of items (dealt by a hash of the id; sizes are summed first).
    Document frequencies and lengths are those of all items. Null items and null ids take no part."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(question).cast("string").alias("q"),
                            (F.col(answer).cast("string") if answer else F.lit(None).cast("string")).alias("a")).filter("item is not null")
    total = rows.agg(F.sum(F.octet_length(F.concat(F.coalesce("q", F.lit("")), F.coalesce("a", F.lit("")))))).first()[0] or 0
    n_indexes = max(1, -(-int(total) // index_bytes))

    def terms(batches):
        for batch in batches:
            units, words = units_of(list(zip(*(c.to_pylist() for c in batch.columns))))
            t = [np.unique(w, return_counts=True)[0].view(np.int64) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array([x for y in t for x in y], pa.int64()), pa.array([1] * sum(map(len, t)), pa.int64())], names=["term", "n"])

    def sizes(batches):
        for batch in batches:
            _, words = units_of(list(zip(*(c.to_pylist() for c in batch.columns))))
            yield pa.RecordBatch.from_arrays([pa.array([len(words)], pa.int64()), pa.array([sum(map(len, words))], pa.int64())], names=["units", "words"])

    df = stored(rows.mapInArrow(terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("df")), "benchmark-terms")
    count = rows.mapInArrow(sizes, "units long, words long").agg(F.sum("units"), F.sum("words")).first()
    n_units, mean = int(count[0] or 0), (count[1] or 0) / max(1, count[0] or 0)
    out = []
    for k in range(n_indexes):
        mine = rows.filter(F.pmod(F.xxhash64("item"), F.lit(n_indexes)) == k).orderBy("item", "q").collect()  # about index_bytes
        units, words = units_of([(r["item"], r["q"], r["a"]) for r in mine])
        if not units:
            continue
        pairs = [np.unique(w, return_counts=True) for w in words]
        term = np.concatenate([p[0] for p in pairs])
        tf = np.concatenate([p[1] for p in pairs]).astype(float)
        unit = np.repeat(np.arange(len(units)), [len(p[0]) for p in pairs])
        wanted = df.sparkSession.createDataFrame(pa.table({"term": np.unique(term).view(np.int64)}).to_pandas()) if n_indexes > 1 else None
        known = {r["term"]: r["df"] for r in (df.join(wanted, "term") if wanted is not None else df).collect()}  # terms of this index
        freq = np.array([known[t] for t in term.view(np.int64).tolist()], float)
        out.append(Index(units, term, unit, tf, freq, np.array([len(w) for w in words], float), n_units, mean))
    return out


HITS = ArrayType(StructType([StructField("item_id", LongType()), StructField("score", DoubleType()),
                             StructField("question_overlap", DoubleType()), StructField("answer_overlap", DoubleType())]))


def find_items(docs: DataFrame, index: Index, text: str = "text", column: str = "benchmark_hits") -> DataFrame:
    """``docs`` with an array of the verified items of one index."""

    def work(texts: pa.Array):
        return [pa.array([[{"item_id": i, "score": s, "question_overlap": q, "answer_overlap": a} for i, s, q, a in found]
                          for found in index.search(texts)],
                         pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])))]

    return with_columns(docs, text, [StructField(column, HITS)], work)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): one row per input row and item found in it;
    ``score`` is the best passage's BM25 as a share of the threshold of an item, or of a unit of a longer item. The items have no answer column:
    ``question_overlap`` is that of the whole item and ``answer_overlap`` is null.

    Null and empty texts hold nothing, repeated rows are reported each, repeated item ids once a document, no items or
    an empty table give no rows; null ids are kept; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for index in build_indexes(benchmark):
        part = find_items(rows, index).select("doc_id", F.explode("benchmark_hits").alias("h")).select("doc_id", "h.*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.limit(0).select("doc_id", F.lit(None).cast(HITS).alias("h")).select("doc_id", F.explode("h").alias("h")).select("doc_id", "h.*")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found, all columns kept."""
    out = docs
    for index in build_indexes(benchmark):
        out = find_items(out, index, text, "_benchmark_hits").filter(F.size("_benchmark_hits") == 0).drop("_benchmark_hits")
    return out
