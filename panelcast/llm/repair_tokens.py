"""Token ids in Re-Pair compressed blocks with random access.

Documents are encoded where they are read; their ids, two bytes each, are then dealt to ranges
of (doc_id, hash of the text), so that one id that many rows share is many ranges, and cut into blocks of whole
documents in that order. In each block frequent pairs of adjacent symbols are replaced by new
symbols, round after round, until no pair is frequent;
the block stores its rules, the length each rule expands to, the symbols left and
where each document's symbols begin. No rule spans documents, so one document is
decoded from its own symbols.

A round replaces a set of pairs at once: the most frequent ones of which none can
overlap another (no symbol is a left part of one and a right part of another). A pair of
equal symbols is replaced from the left of each run.
The blocks are a Parquet table, sorted by shard and block; a lost task is rewritten by Spark's commit protocol.
"""

from __future__ import annotations

import json
import zlib
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.cross_tokens import byte_letters
from panelcast.llm.routed import runs_of
from panelcast.llm.words import WordCache, as_strings, chunks, give_back, split_words
from panelcast.operators.windows import range_of
from panelcast.session import scratch_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
BLOCK_IDS = 1 << 19
RULES_A_ROUND, LEAST = 4096, 8
CACHED_WORDS = 2_000_000
SLOT_BITS, _SPREAD = 18, np.uint64(0x9E3779B97F4A7C15)
#: Documents sampled for the ranges of doc_ids, and ranges for each shuffle partition.
SAMPLED, RANGES = 20_000, 4

_ENCODERS: dict = {}

SCHEMA = ("shard int, block int, n_ids long, doc_ids array<long>, doc_symbols binary, "
          "rules binary, expansions binary, symbols binary")


class WordEncoder:
    """Encodes texts by their words. White space always splits this vocabulary's
    words and A-Z is lowered by it, so a word's ids don't depend on its neighbours;
    texts that may hold a special token's string are encoded whole.

    A word of lower-case letters is one piece: its bytes and a word end. A piece's merges are in the order of the ids, so ``tiktoken``
    finds them from the vocabulary alone (the word end stands as byte 0xFF, which UTF-8 never has); all other
    words go through the tokenizer itself."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        of, special = byte_letters(), {t["content"] for t in made["added_tokens"]}
        ranks = {}
        for t, i in made["model"]["vocab"].items():
            if t not in special:
                body = t.removesuffix("</w>")
                ranks[bytes(of[c] for c in body) + (b"" if body == t else b"\xff")] = i
        self.piece = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.cache, self.ids, self.at = WordCache(CACHED_WORDS), np.zeros(1 << 16, np.uint16), 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> np.ndarray:
        """(start, length) of each word's ids in the flat store, which grows by doubling."""
        if self.cache.values is None:
            self.at = 0
        piece = self.piece
        ids = [piece(w.encode() + b"\xff") if w.isalpha() and (w.isascii() or w == w.lower() and is_normalized("NFC", w)) else None for w in words]
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(rest, self._whole([words[i] for i in rest])):
            ids[i] = x
        n = np.array([len(x) for x in ids], np.int64)
        start, stop = self.at + np.cumsum(n) - n, self.at + int(n.sum())
        if stop > len(self.ids):
            grown = np.zeros(max(stop, 2 * len(self.ids)), np.uint16)
            grown[:self.at] = self.ids[:self.at]
            self.ids = grown
        self.ids[self.at:stop] = np.fromiter(chain.from_iterable(ids), np.uint16, stop - self.at)
        self.at = stop
        return np.stack([start, n], axis=1).astype(np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with END_ID after each, number of ids of each text)."""
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        plain = texts if not special.any() else pc.if_else(pa.array(special), "", texts)
        # a blank between a letter and the ASCII marks behind it splits where the vocabulary does
        plain = pc.replace_substring_regex(pc.ascii_lower(plain), r"(\pL)([!-/:-@\[-`{-~]+)", r"\1 \2")
        codes, first, words = split_words(plain)
        if len(words):
            spans = self.cache.rows(words, self._learn)
            n, start = spans[codes, 1], spans[codes, 0]
            ids = self.ids[_ranges(start, n)]
        else:
            n, ids = np.zeros(0, np.int64), np.zeros(0, np.uint16)
        upto = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        lengths = np.diff(upto[first])
        if special.any():
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            for i in np.flatnonzero(special):
                parts[i] = np.array(self._whole([texts[int(i)].as_py()])[0], np.uint16)
            lengths = np.array([len(p) for p in parts])
            ids = np.concatenate(parts)
        out = np.full(len(ids) + len(lengths), END_ID, np.int32)
        stops = np.cumsum(lengths + 1) - 1
        inner = np.ones(len(out), bool)
        inner[stops] = False
        out[inner] = ids
        return out, lengths + 1


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+n[0]-1, start[1] .. in one array."""
    upto = np.cumsum(n)
    total = int(upto[-1]) if len(upto) else 0
    return np.repeat(start - (upto - n), n) + np.arange(total)


def _chosen(left: np.ndarray, right: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """Positions of pairs, by falling count, that can't overlap one another."""
    if len(count) > 4 * most:  # the pairs come ordered, so ties keep to the smaller pair
        least = np.partition(count, len(count) - 4 * most)[len(count) - 4 * most]
        some = np.flatnonzero(count >= least)
    else:
        some = np.arange(len(count))
    some = some[np.argsort(-count[some], kind="stable")]
    lefts, rights, out = set(), set(), []
    for i, a, b in zip(some.tolist(), left[some].tolist(), right[some].tolist()):
        if a not in rights and b not in lefts and (a != b or a not in lefts and a not in rights):
            out.append(i)
            lefts.add(a)
            rights.add(b)
            if len(out) == most:
                break
    return np.array(out, np.int64)


def compress(ids: np.ndarray, starts: np.ndarray, most: int = RULES_A_ROUND, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of one block: (rules as pairs, expansion length per rule, symbols left,
    symbols of each document). ``starts``: where documents begin. Symbols from
    2**16 up are rules in order."""
    seq = ids.astype(np.int32)
    head = np.zeros(len(seq), bool)
    head[starts[starts < len(seq)]] = True
    rules: list[np.ndarray] = []
    n_rules = 0
    # where a pair may be frequent: at first anywhere, later where one was or where a new symbol lies; other pairs only get rarer
    near = np.arange(max(len(seq) - 1, 0))
    while len(near):  # every round makes the sequence shorter
        near = near[~head[near + 1]]
        left, right = seq[near], seq[near + 1]
        keys = (left.astype(np.int64) << 32) | right
        # of pairs of equal symbols in a run, every other one counts and can be replaced
        twin = np.flatnonzero(left == right)
        if len(twin):
            new = np.flatnonzero(np.diff(near[twin], prepend=-2) > 1)
            nth = np.arange(len(twin)) - np.repeat(new, np.diff(np.append(new, len(twin))))
            keys[twin[nth % 2 == 1]] = -1
        # pairs that share a slot of a hash table with few others can't be frequent; only the rest is sorted
        slot = keys.view(np.uint64) * _SPREAD
        slot >>= np.uint64(64 - SLOT_BITS)
        slot = slot.view(np.int64)
        some = np.flatnonzero((np.bincount(slot, minlength=1 << SLOT_BITS) >= least)[slot] | (keys < 0))
        near, keys = near[some], keys[some]
        ordered = np.sort(keys)
        ordered = ordered[np.searchsorted(ordered, 0):]
        if not len(ordered):
            break
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(np.append(edge, len(ordered)))
        often = count >= least
        pair, count = ordered[edge[often]], count[often]
        take = _chosen(pair >> 32, pair & 0xFFFFFFFF, count, most)
        if not len(take):
            break
        picked = np.sort(pair[take])
        part = np.zeros((1 << 16) + n_rules + len(picked), np.uint8)
        part[picked >> 32] |= 1
        part[picked & 0xFFFFFFFF] |= 2
        maybe = np.flatnonzero((keys >= 0) & (part[seq[near]] & (part[seq[near + 1]] >> 1) & 1).astype(bool))
        spot = np.minimum(np.searchsorted(picked, keys[maybe]), len(picked) - 1)
        hit = picked[spot] == keys[maybe]
        at = near[maybe[hit]]
        seq[at] = (1 << 16) + n_rules + spot[hit]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        place = np.cumsum(keep, dtype=np.int32) - 1
        rest = np.zeros(len(seq), bool)
        rest[place[near[keep[near]]]] = True
        rest[place[at]] = True
        rest[np.maximum(place[at] - 1, 0)] = True
        seq, head = seq[keep], head[keep]
        near = np.flatnonzero(rest[:max(len(seq) - 1, 0)])
        rules.append(np.stack([picked >> 32, picked & 0xFFFFFFFF], axis=1))
        n_rules += len(picked)
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return pairs, expansion_lengths(pairs), seq.astype(np.int64), np.diff(np.append(np.flatnonzero(head), len(seq)))


def expansion_lengths(pairs: np.ndarray) -> np.ndarray:
    """Ids that each rule stands for; a rule is made of ids and earlier rules."""
    size = [1] * (1 << 16)
    for a, b in pairs.tolist():
        size.append(size[a] + size[b])
    return np.array(size[1 << 16:], np.int64)


def expand(pairs: np.ndarray, lengths: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The ids that ``symbols`` stand for."""
    flat = np.zeros(int(lengths.sum()), np.int64)
    start = np.cumsum(lengths) - lengths
    for i, (a, b) in enumerate(pairs.tolist()):
        at = start[i]
        for s in (a, b):
            if s >= 1 << 16:
                n, src = lengths[s - (1 << 16)], start[s - (1 << 16)]
                flat[at:at + n] = flat[src:src + n]
                at += n
            else:
                flat[at] = s
                at += 1
    # plain symbols stand behind the expansions
    rule = symbols >= 1 << 16
    store = np.concatenate([flat, symbols[~rule]])
    n = np.ones(len(symbols), np.int64)
    n[rule] = lengths[symbols[rule] - (1 << 16)]
    begin = np.empty(len(symbols), np.int64)
    begin[rule] = start[symbols[rule] - (1 << 16)]
    begin[~rule] = len(flat) + np.arange(int((~rule).sum()))
    return store[_ranges(begin, n)].astype("<u4")


def decode_document(row, k: int) -> np.ndarray:
    """Ids of document ``k`` of one block (a row of the table), from its own symbols alone."""
    pairs = np.frombuffer(row["rules"], "<u4").reshape(-1, 2).astype(np.int64)
    counts = np.frombuffer(row["doc_symbols"], "<u4")
    symbols = np.frombuffer(row["symbols"], "<u4")[int(counts[:k].sum()):int(counts[:k + 1].sum())].astype(np.int64)
    return expand(pairs, np.frombuffer(row["expansions"], "<u4").astype(np.int64), symbols)


def _ranges_of_ids(docs: DataFrame, n: int) -> list[tuple]:
    """At most ``n`` - 1 ascending (doc_id, hash) pairs that cut the rows into even ranges, from a sample of about
    ``SAMPLED`` rows chosen by a hash; a null id stands as (False, 0, hash)."""
    rows = docs.count()
    step = max(1, rows // SAMPLED)
    some = docs.filter(F.pmod(F.xxhash64(F.lit(2), "doc_id", "tie"), F.lit(step)) == 0).select("doc_id", "tie").collect()
    keys = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["tie"]) for r in some)
    return sorted({keys[i * len(keys) // n] for i in range(1, n)} if keys else set())


def write_tokens(docs: DataFrame, path: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode all documents in ascending doc_id order (null first, then by a hash of the text) into blocks under
    ``path``. A shard is a range of that order; blocks bound what Re-Pair holds at once."""

    def encode(batches):
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = WordEncoder(vocabulary)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, n = _ENCODERS[vocabulary].encode(as_strings(part.column(3)))
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32) * np.int32(2)
                made = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], made], names=["shard", "doc_id", "tie", "ids"])

    def blocks(batches):
        shard, block, names, ids, lengths, held = None, 0, [], [], [], 0

        def flush():
            nonlocal names, ids, lengths, held, block
            n = np.concatenate(lengths)
            pairs, sizes, symbols, per_doc = compress(np.concatenate(ids), np.cumsum(n) - n)
            row = [shard, block, held, pa.concat_arrays(names).to_pylist(), *(x.astype("<u4").tobytes() for x in (per_doc, pairs, sizes, symbols))]
            names, ids, lengths, held, block = [], [], [], 0, block + 1
            give_back()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, ARROW)], schema=ARROW)

        for batch in batches:
            shards = batch.column(0).to_numpy()
            for part in chunks(batch, "ids", BLOCK_IDS):
                at = shards[:part.num_rows]
                shards = shards[part.num_rows:]
                for start, stop in runs_of(at):
                    if at[start] != shard:
                        if names:
                            yield flush()
                        shard, block = int(at[start]), 0
                    column = part.column(3).slice(start, stop - start)
                    off = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
                    names.append(part.column(1).slice(start, stop - start))
                    ids.append(np.frombuffer(column.buffers()[2], "<u2")[off[0] // 2:off[-1] // 2].astype(np.int32))
                    lengths.append(np.diff(off).astype(np.int64) // 2)
                    held += len(ids[-1])
                    if held >= BLOCK_IDS:
                        yield flush()
        if names:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    cuts = _ranges_of_ids(rows, RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), F.col("tie"))
    held = F.array(*[F.struct(F.lit(a), F.lit(b).cast("long"), F.lit(c).cast("long")) for a, b, c in cuts]) if cuts else None
    rows = rows.withColumn("shard", F.lit(0) if held is None else range_of(key, held))
    (rows.select("shard", "doc_id", "tie", "text").mapInArrow(encode, "shard int, doc_id long, tie long, ids binary")
     .repartition("shard").sortWithinPartitions("shard", "doc_id", "tie")
     .mapInArrow(blocks, SCHEMA).write.parquet(path))


ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                   ("doc_symbols", pa.binary()), ("rules", pa.binary()), ("expansions", pa.binary()), ("symbols", pa.binary())])


def read_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the blocks, all ids decoded."""

    def decode(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                pairs = np.frombuffer(row["rules"], "<u4").reshape(-1, 2).astype(np.int64)
                sizes = np.frombuffer(row["expansions"], "<u4").astype(np.int64)
                symbols = np.frombuffer(row["symbols"], "<u4").astype(np.int64)
                ids = expand(pairs, sizes, symbols)
                width = np.ones(len(symbols), np.int64)
                rule = symbols >= 1 << 16
                width[rule] = sizes[symbols[rule] - (1 << 16)]
                upto = np.concatenate([[0], np.cumsum(width)])
                edge = upto[np.concatenate([[0], np.cumsum(np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64))])]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:])]
                m = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * m, pa.int32()), pa.array([row["block"]] * m, pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                     pa.array(edge[:-1]), pa.array(np.diff(edge)), pa.array(crc, pa.int64())],
                    names=["shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])
                del row, ids, symbols
                give_back()

    docs = blocks.mapInArrow(decode, "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # ids before a block: shards before its shard (a row each), and blocks before it in its shard
    sums = blocks.select("shard", "block", "n_ids")
    shards = sums.groupBy("shard").agg(F.sum("n_ids").alias("s"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(F.col("shard").alias("_s"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("shard_base"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = (sums.withColumn("b", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).join(shards, F.col("shard") == F.col("_s"))
             .select("shard", "block", (F.col("b") + F.col("shard_base")).alias("base")))
    return docs.join(bases, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("inside")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def token_file(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the token blocks in the shared folder and read them back: doc_id, start (ids of all
    documents before it), n_tokens (with the end id), ids_crc32 per row.

    Null and empty texts are documents of the end id alone; null ids come first; rows of one id follow each other
    by a hash of the text; an empty table gives no rows; other columns are not read.
    """
    path = scratch_path(docs.sparkSession, "repair-tokens")
    write_tokens(docs, path, vocabulary, doc_id, text)
    return read_documents(docs.sparkSession.read.schema(SCHEMA).parquet(path))
