"""Alignment of two tokenizers: byte cuts they share, and how often two ids end together.

Each text is encoded by both tokenizers; byte offsets at which a token of either ends cut both
sequences into groups, and the two tokens that end there are linked. The counts of linked id pairs
over the whole corpus come from an external count: a task gathers (pair, document) records up to a
bound and then spills them, parted by the low bits of the side-B id (the radix) and sorted by
(B, A, document), as zstd runs in rows of a table of the shared folder. Runs of a radix are merged
by a heap, at most ``FAN_IN`` (or some ``RUN_BYTES``) at a time, until one run a radix is left; it is in B-major order, so the
maximum of each B id is known as soon as its pairs have passed. The record runs then stream by
their radix's counts, and each gives back what its documents gain. No step holds more than one merged
run or one radix's counts (bounded by the vocabularies), and no hot id meets in one task: its records stay in their runs, which
are dealt by salts.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.minimal_hash import from_bytes, to_bytes
from panelcast.llm.routed import asked, grouped
from panelcast.llm.scratch import stored
from panelcast.llm.words import as_strings, chunks, give_back

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed value: the word pattern of byte-level BPE vocabularies of this kind.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RADIX = 32
#: Records and documents of a spill at most (a single document may have more records).
SPILL_RECORDS, SPILL_DOCS = 1 << 20, 60_000
RUN_BYTES, FAN_IN = 16 << 20, 64
ENCODE_BYTES = 1 << 20
#: The regular expression engine keeps a state for each blank of a run; longer runs go another way.
BLANK_RUN = 10_000

_MODELS: dict = {}


def byte_letters() -> dict[str, int]:
    """Letter of each byte in byte-level vocabularies: printable bytes stand for themselves, the
    others for the letters from U+0100 in their order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """Byte-level BPE. The ids are those of the ``tokenizers`` library for the file; its merges are in
    the order of the ids, so the much faster ``tiktoken`` finds the same ids from the file's vocabulary.
    Texts that its word pattern can't take (very long runs of blanks) are encoded by the former."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        special = {t["content"] for t in made["added_tokens"]}
        of = byte_letters()
        self.ranks = {bytes(of[c] for c in t): i for t, i in made["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=self.ranks, special_tokens={})
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        self.blanks = re.compile(r"\s{%d}" % BLANK_RUN)

    def table(self) -> list[bytes]:
        out = [b""] * (max(self.ranks.values()) + 1)
        for t, i in self.ranks.items():
            out[i] = t
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for x in texts:
            x = " " + x
            if len(x) > BLANK_RUN and self.blanks.search(x):
                out.append(self.exact.encode(x, add_special_tokens=False).ids)
            else:
                out.append(self.fast.encode_ordinary(x))
        return out


class PieceTokens:
    """A sentencepiece model; it puts the blank before the text itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def table(self) -> list[bytes]:
        out = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            hexed = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)
            out.append(bytes([int(hexed[1], 16)]) if hexed else piece.replace("▁", " ").encode())
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


class Side:
    """A tokenizer with the bytes and lengths of its ids."""

    def __init__(self, tokens):
        self.tokens, self.bytes = tokens, tokens.table()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    @classmethod
    def of(cls, kind: type, path: str) -> Side:
        if (kind, path) not in _MODELS:
            _MODELS[kind, path] = cls(kind(path))
        return _MODELS[kind, path]


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1 as bytes, left-justified with one place to spare, and their counts."""
    width = len(str(n))
    numbers = np.arange(n)
    count = np.ones(n, np.int64)
    for k in range(1, width):
        count += numbers >= 10**k
    out = np.zeros((n, width + 1), np.uint8)
    for k in range(width):
        has = k < count
        out[has, k] = 48 + (numbers[has] // 10 ** (count[has] - 1 - k)) % 10
    return out, count


class Aligner:
    """Aligns batches of texts; see ``align``."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.digits, self.width = _digits(max(len(a.bytes), len(b.bytes)))

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(ids of A, of B, tokens of A a text, of B). A text has none if it is empty or if either
        side's bytes are not a blank and the text."""
        some = [i for i, x in enumerate(texts) if x]
        sides, sizes = [], []
        given = [texts[i] for i in some]
        wanted = [b" " + x.encode() for x in given]
        good = np.ones(len(some), bool)
        for side in (self.a, self.b):
            ids = side.tokens.encode(given)
            flat = np.array(list(chain.from_iterable(ids)), np.int64)
            n = np.array([len(x) for x in ids], np.int64)
            joined = b"".join([side.bytes[i] for i in flat.tolist()])
            if joined != b"".join(wanted) or (self._sums(side.lengths[flat], n) != [len(w) for w in wanted]).any():
                good &= [b"".join([side.bytes[i] for i in x]) == w for x, w in zip(ids, wanted)]
            sides.append(flat)
            sizes.append(n)
        out = []
        for flat, n in zip(sides, sizes):
            full = np.zeros(len(texts), np.int64)
            full[some] = np.where(good, n, 0)
            out += [flat[np.repeat(good, n)], full]
        return out[0], out[2], out[1], out[3]

    @staticmethod
    def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        ends = np.cumsum(n)
        return total[ends] - total[ends - n]

    def align(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Per text n_a, n_b, n_groups; of all links in order link_a, link_b; and what ``spell`` reads."""
        ids_a, ids_b, n_a, n_b = self.encoded(texts)
        ends_a, ends_b = np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b])
        seen = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, np.uint8)
        seen[ends_a] |= 1
        seen[ends_b] |= 2
        cut_a, cut_b = seen[ends_a] == 3, seen[ends_b] == 3
        return {"ids_a": ids_a, "ids_b": ids_b, "n_a": n_a, "n_b": n_b, "cut_a": cut_a, "cut_b": cut_b,
                "n_groups": self._sums(cut_a, n_a), "link_a": ids_a[cut_a], "link_b": ids_b[cut_b]}

    def spell(self, made: dict[str, np.ndarray]) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text: the decimal ids of each group."""
        cut_a, cut_b, n_a, n_b = (made[k] for k in ("cut_a", "cut_b", "n_a", "n_b"))
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        stop_a, stop_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
        begin_b = np.concatenate([[0], stop_b])
        n = len(group_a) + len(group_b)
        ids, mark = np.zeros(n, np.int64), np.zeros(n, np.uint8)
        at_a = np.arange(len(group_a)) + begin_b[group_a]
        at_b = np.arange(len(group_b)) + stop_a[group_b]
        ids[at_a], ids[at_b] = made["ids_a"], made["ids_b"]
        mark[at_a], mark[at_b] = np.where(cut_a, ord("|"), ord(",")), np.where(cut_b, ord(";"), ord(","))
        width = self.width[ids]
        last = np.cumsum(n_a + n_b)[n_a > 0] - 1  # no mark after a text's last id
        text = self.digits[ids]
        text[np.arange(n), width] = mark
        long = width + 1
        long[last] -= 1
        flat = text[np.arange(text.shape[1]) < long[:, None]].tobytes()
        ends = np.cumsum(self._sums(long, n_a + n_b)).tolist()
        return [flat[x:y] for x, y in zip([0, *ends[:-1]], ends)]


def _packed(**arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(to_bytes(**arrays))


def _unpacked(blob: bytes) -> dict[str, np.ndarray]:
    return from_bytes(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31))


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


class Spill:
    """(pair, document, count) records of a task, put out as sorted runs by radix when they are many.
    A pair is the B id in the upper and the A id in the lower bits."""

    def __init__(self):
        self.number = int.from_bytes(os.urandom(8), "little", signed=True)
        self.docs, self.records, self.parts = 0, 0, []

    def add(self, doc: np.ndarray, link_a: np.ndarray, link_b: np.ndarray) -> None:
        key, n = np.unique((link_b << 48) | (link_a << 24) | doc, return_counts=True)
        self.parts.append((key, n))
        self.records += len(key)

    def full(self, records: int, docs: int) -> bool:
        return self.records >= records or self.docs >= docs

    def runs(self):
        """(radix, pair run, record run), each run as bytes."""
        if not self.records:
            return
        key = np.concatenate([k for k, _ in self.parts])
        n = np.concatenate([x for _, x in self.parts])
        radix = (key >> 48) % RADIX
        order = np.lexsort((key, radix))
        key, n, radix = key[order], n[order], radix[order]
        stops = np.searchsorted(radix, np.arange(RADIX + 1))
        for r in range(RADIX):
            k, c = key[stops[r]:stops[r + 1]], n[stops[r]:stops[r + 1]]
            if not len(k):
                continue
            pair = (k >> 48 << 24) | (k >> 24 & 0xFFFFFF)
            start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            pairs = {"pair": np.diff(pair[start], prepend=0), "n": np.add.reduceat(c, start)}
            records = {"pair": pairs["pair"], "docs": np.diff(np.append(start, len(k))), "doc": k & 0xFFFFFF, "n": c}
            yield r, _packed(**{x: _narrow(y) for x, y in pairs.items()}), _packed(**{x: _narrow(y) for x, y in records.items()})


_SPILLED = ("spill long, idx int, doc_id long, n_a long, n_b long, n_groups long, groups string, "
            "radix int, pairs binary, records binary")


def spilled(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", spell: bool = False,
            spill_records: int = SPILL_RECORDS, spill_docs: int = SPILL_DOCS) -> DataFrame:
    """The documents' alignments (idx not null) and the runs of their spills (radix not null) as rows
    of one table. ``groups`` is the spelled alignment, or its SHA-256 in hex; empty without tokens."""

    def run(batches):
        aligner, spill = Aligner(Side.of(ByteTokens, a_path), Side.of(PieceTokens, b_path)), Spill()
        names = [x.split()[0] for x in _SPILLED.split(", ")]
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.int32(), pa.binary(), pa.binary()]

        def rows(n, **columns):
            return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in zip(names, kinds)], names=names)

        def put_out(spill):
            for radix, pairs, records in spill.runs():
                yield rows(1, spill=[spill.number], radix=[radix], pairs=[pairs], records=[records])
            give_back()

        for batch in batches:
            for part in chunks(batch, "text", ENCODE_BYTES):
                made = aligner.align(as_strings(part.column(1)).to_pylist())
                groups = aligner.spell(made)
                n, some = part.num_rows, made["n_a"] > 0
                if not spell:
                    groups = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                else:
                    groups = [g.decode() for g in groups]
                idx = np.arange(spill.docs, spill.docs + n)
                yield rows(n, spill=np.full(n, spill.number), idx=idx, doc_id=part.column(0), n_a=made["n_a"], n_b=made["n_b"],
                           n_groups=made["n_groups"], groups=groups)
                if some.any():
                    spill.add(np.repeat(idx, made["n_groups"]), made["link_a"], made["link_b"])
                spill.docs += n
                if spill.full(spill_records, spill_docs):
                    yield from put_out(spill)
                    spill = Spill()
        yield from put_out(spill)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _SPILLED)


def _entries(blob: bytes):
    run = _unpacked(blob)
    return zip(np.cumsum(run["pair"], dtype=np.int64).tolist(), run["n"].tolist())


def _merged(key: tuple, parts: list[pa.RecordBatch]):
    """One run of the sums of all runs of a group, by a heap over their heads."""
    blobs = [x for p in parts for x in p.column(p.schema.get_field_index("pairs")).to_pylist()]
    if len(blobs) == 1:
        made = blobs[0]
    else:
        pairs, sums, held, total = [], [], -1, 0
        for pair, n in heapq.merge(*map(_entries, blobs)):
            if pair == held:
                total += n
                continue
            if held >= 0:
                pairs.append(held)
                sums.append(total)
            held, total = pair, n
        pairs.append(held)
        sums.append(total)
        made = _packed(pair=_narrow(np.diff(np.array(pairs, np.int64), prepend=0)), n=_narrow(np.array(sums, np.int64)))
    yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([made], pa.binary())],
                                     names=["radix", "salt", "pairs"])


def _salts(runs: DataFrame, column: str, most: int) -> list[int]:
    """Salts of each radix, so that a salt has about ``most`` bytes; one row a radix goes through the driver."""
    sizes = {r["radix"]: r["size"] for r in runs.groupBy("radix").agg(F.sum(F.length(column)).alias("size")).collect()}
    return [max(1, -(-sizes.get(r, 0) // most)) for r in range(RADIX)]


def _per_radix(values: list[int]):
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("radix") + 1)


def pair_runs(runs: DataFrame, run_bytes: int = RUN_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """(radix, salt, pairs): one run a radix with the corpus-wide count of each pair, merged in rounds."""
    salts = _salts(runs, "pairs", run_bytes)
    merging = runs.select("radix", F.pmod(F.xxhash64("spill"), _per_radix(salts)).cast("int").alias("salt"), "pairs")
    while True:
        merging = stored(grouped(merging, ["radix", "salt"], "radix int, salt int, pairs binary", _merged), "pair-runs")
        if max(salts) == 1:
            return merging
        salts = [-(-s // fan_in) for s in salts]
        merging = merging.withColumn("salt", F.floor(F.col("salt") / fan_in).cast("int"))


class Counts:
    """A radix's pairs in B-major order with their counts and whether they are their B id's highest."""

    def __init__(self, blob: bytes):
        run = _unpacked(blob)
        self.pair, self.n = np.cumsum(run["pair"], dtype=np.int64), run["n"].astype(np.int64)
        b = self.pair >> 24
        start = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        most = np.repeat(np.maximum.reduceat(self.n, start), np.diff(np.append(start, len(b))))
        self.best = self.n == most

    def gains(self, blob: bytes) -> tuple[np.ndarray, ...]:
        """(documents, links that are best, sums of counts) of a record run."""
        run = _unpacked(blob)
        at = np.repeat(np.searchsorted(self.pair, np.cumsum(run["pair"], dtype=np.int64)), run["docs"])
        n, doc = run["n"].astype(np.int64), run["doc"].astype(np.int64)
        docs, place = np.unique(doc, return_inverse=True)
        best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        np.add.at(best, place, n * self.best[at])
        np.add.at(total, place, n * self.n[at])
        return docs, best, total


_GAINS = "spill long, docs array<int>, best array<long>, total array<long>"


def _gains(counts: Counts, batch: pa.RecordBatch) -> pa.RecordBatch:
    records = batch.column(batch.schema.get_field_index("records"))
    made = [counts.gains(r.as_py()) for r in records]
    columns = [pa.array([m[i] for m in made], pa.list_(t)) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("spill")), *columns], names=["spill", "docs", "best", "total"])


def _by_document(key: tuple, parts: list[pa.RecordBatch]):
    """Sums over the radixes of a spill's documents (at most ``SPILL_DOCS`` and a batch)."""
    flat = [np.concatenate([p.column(i).flatten().to_numpy() for p in parts]) for i in (1, 2, 3)]
    docs, place = np.unique(flat[0], return_inverse=True)
    sums = [np.zeros(len(docs), np.int64) for _ in range(2)]
    for out, values in zip(sums, flat[1:]):
        np.add.at(out, place, values)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), key[0])), pa.array(docs, pa.int32()), *map(pa.array, sums)],
                                     names=["_spill", "_idx", "n_best", "count_sum"])


def cross_tokenized(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text",
                    spell: bool = False, run_bytes: int = RUN_BYTES, fan_in: int = FAN_IN,
                    spill_records: int = SPILL_RECORDS, spill_docs: int = SPILL_DOCS) -> DataFrame:
    """Per row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups.

    A link is two tokens, one of each side, that end at the same byte; its count is how many links of
    the whole corpus join the same two ids. ``n_best`` counts links whose count is the highest of their
    B id (ties included), ``count_sum`` adds up the counts. ``groups`` is the SHA-256 in hex of the spelled
    groups (``spell=True``: the groups themselves, about five times the text). Texts that are null,
    empty, or not given back byte by byte by either tokenizer have no tokens: zeros and an empty ``groups``.
    Every row is a document, null and repeated ids included; other columns are not read; an empty table
    gives no rows.
    """
    table = stored(spilled(docs, a_path, b_path, doc_id, text, spell, spill_records, spill_docs), "token-spills")
    runs = table.filter("radix is not null")
    counted = pair_runs(runs, run_bytes, fan_in)
    salts = _salts(runs, "records", run_bytes)
    index = counted.select(F.col("radix").alias("shard"), F.col("pairs").alias("blob"),
                           F.explode(F.sequence(F.lit(0), _per_radix(salts).cast("int") - 1)).alias("salt"))
    asking = runs.select(F.col("radix").alias("shard"), F.pmod(F.xxhash64("spill"), _per_radix(salts)).cast("int").alias("salt"), "spill", "records")
    gains = asked(index, asking, _GAINS, Counts, _gains)
    gains = grouped(gains, ["spill"], "_spill long, _idx int, n_best long, count_sum long", _by_document)
    rows = table.filter("idx is not null").select("spill", "idx", "doc_id", "n_a", "n_b", "n_groups", "groups")
    return rows.join(gains, (F.col("spill") == F.col("_spill")) & (F.col("idx") == F.col("_idx")), "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"),
        F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"), "groups")
