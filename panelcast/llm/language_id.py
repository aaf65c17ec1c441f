"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A
word's likelihood is the sum over all its segmentations into pieces of the product of
their probabilities (a forward pass over the word's characters); a text's is the
product over its words. Piece probabilities are fitted by expectation maximisation:
backward passes give every piece's expected count over all segmentations.

Words are lower-cased runs of letters with a word-start mark in front. A character
that is no piece of the vocabulary has one shared probability, so no word is impossible.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from panelcast.llm.scratch import stored
from panelcast.llm.words import WordCache, as_strings, chunks, letter_words, mix64, split_words, sums_by_text, with_columns

VOCABULARY = "piece_bpe_32k.model"
START = "▁"
#: Longer words take their pass in logarithms, one by one, as plain products could underflow.
PLAIN_WORD = 32
#: Expected documents per language the model is fitted on; all others are only predicted.
SAMPLE_DOCS = 600
ITERATIONS = 4
SMOOTHING = 0.05
CACHED_WORDS = 500_000
_MUL = np.uint64(0x9E3779B97F4A7C15)


def pieces_of(path: str) -> list[str]:
    """Pieces of letters only, lower case, with or without the word-start mark."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = set()
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        p = model.id_to_piece(i)
        body = p.removeprefix(START)
        if (p == START or body.isalpha()) and p == p.lower():
            out.add(p)
    return sorted(out)


def _codes(words: Sequence[str]) -> np.ndarray:
    """Code points of equally long words, one row each."""
    return np.array(words, dtype=f"<U{len(words[0])}").view(np.uint32).reshape(len(words), -1).astype(np.uint64)


def _start(n: int) -> np.ndarray:
    return np.zeros(n, np.uint64)


@dataclass
class Lattice:
    """All prefixes of the vocabulary's pieces as sorted 64-bit hashes, with the piece each is (-1: none) and
    whether a longer piece begins with it."""

    keys: np.ndarray
    ids: np.ndarray
    more: np.ndarray
    size: int

    @staticmethod
    def of(pieces: Sequence[str]) -> Lattice:
        number = {p: i for i, p in enumerate(pieces)}
        longer = {p[:k] for p in pieces for k in range(1, len(p))}
        by_length: dict[int, list[str]] = {}
        for p in sorted(longer | number.keys()):
            by_length.setdefault(len(p), []).append(p)
        h, ids, more = [np.zeros(0, np.uint64)], [], []
        for n, some in by_length.items():
            codes, x = _codes(some), _start(len(some))
            for k in range(n):
                x = mix64(x * _MUL + codes[:, k] + np.uint64(1))
            h.append(x)
            ids += [number.get(p, -1) for p in some]
            more += [p in longer for p in some]
        keys = np.concatenate(h)
        order = np.argsort(keys)
        return Lattice(keys[order], np.array(ids, np.int32)[order], np.array(more, bool)[order], len(pieces))

    def look_up(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece or -1, whether a longer piece may follow) of hashed strings."""
        if not len(self.keys):
            return np.full(len(x), -1, np.int32), np.zeros(len(x), bool)
        spot = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        known = self.keys[spot] == x
        return np.where(known, self.ids[spot], np.int32(-1)), known & self.more[spot]

    def arcs(self, codes: np.ndarray):
        """(start, stop, rows, piece ids) of all pieces found in words of one length; id
        ``size`` is a character that is no piece."""
        n, length = codes.shape
        for i in range(length):
            x, rows = _start(n), np.arange(n)
            for j in range(i, length):
                x = mix64(x * _MUL + codes[rows, j] + np.uint64(1))
                piece, more = self.look_up(x)
                if j == i:
                    yield i, j + 1, rows, np.where(piece < 0, self.size, piece)
                elif (piece >= 0).any():
                    yield i, j + 1, rows[piece >= 0], piece[piece >= 0]
                rows, x = rows[more], x[more]
                if not len(rows):
                    break

    def arcs_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, stops, piece ids) of all pieces found in one word, all starts at once."""
        starts, x, found = np.arange(len(codes)), _start(len(codes)), []
        for k in range(len(codes)):
            x = mix64(x * _MUL + codes[starts + k] + np.uint64(1))
            piece, more = self.look_up(x)
            if k == 0:
                piece = np.where(piece < 0, self.size, piece)
            hit = piece >= 0
            found.append((starts[hit], starts[hit] + k + 1, piece[hit]))
            more &= starts + k + 1 < len(codes)
            starts, x = starts[more], x[more]
            if not len(starts):
                break
        return tuple(np.concatenate(c) for c in zip(*found))


def _by_length(words: Sequence[str]):
    """(rows, words with the start mark) of equal length."""
    groups: dict[int, tuple[list[int], list[str]]] = {}
    for k, w in enumerate(words):
        w = START + w.replace("\0", "")  # numpy drops trailing zero characters
        rows, same = groups.setdefault(len(w), ([], []))
        rows.append(k)
        same.append(w)
    for n, (rows, same) in groups.items():
        step = 8192 if n <= PLAIN_WORD else 1
        for at in range(0, len(rows), step):
            yield np.array(rows[at:at + step]), _codes(same[at:at + step])


def _log_forward(length: int, starts: np.ndarray, stops: np.ndarray, log_prob: np.ndarray) -> np.ndarray:
    """Log of the summed products of all paths from 0 to each position (row), by column of ``log_prob`` (a row per arc)."""
    order = np.argsort(stops, kind="stable")
    starts, log_prob = starts[order], log_prob[order]
    first = np.searchsorted(stops[order], np.arange(length + 2))
    out = np.zeros((length + 1, log_prob.shape[1]))
    for j in range(1, length + 1):
        ways = out[starts[first[j]:first[j + 1]]] + log_prob[first[j]:first[j + 1]]
        most = ways.max(axis=0)
        out[j] = most + np.log(np.exp(ways - most).sum(axis=0))
    return out


def word_scores(lattice: Lattice, prob: np.ndarray, words: Sequence[str]) -> np.ndarray:
    """log P(word | language) for each word (row) and language (column of ``prob``)."""
    out = np.zeros((len(words), prob.shape[1]))
    for rows, codes in _by_length(words):
        if codes.shape[1] > PLAIN_WORD:
            starts, stops, piece = lattice.arcs_of(codes[0])
            out[rows[0]] = _log_forward(codes.shape[1], starts, stops, np.log(prob[piece]))[-1]
            continue
        alpha = np.zeros((codes.shape[1] + 1, len(rows), prob.shape[1]))
        alpha[0] = 1
        for i, j, at, piece in lattice.arcs(codes):
            alpha[j, at] += alpha[i, at] * prob[piece]
        out[rows] = np.log(alpha[-1])
    return out


def expected_counts(lattice: Lattice, prob: np.ndarray, words: Sequence[str], counts: np.ndarray) -> np.ndarray:
    """Expected number of uses of every piece over all segmentations, for one language."""
    out = np.zeros(len(prob))
    for rows, codes in _by_length(words):
        length = codes.shape[1]
        if length > PLAIN_WORD:
            starts, stops, piece = lattice.arcs_of(codes[0])
            log_prob = np.log(prob[piece])
            ahead = _log_forward(length, starts, stops, log_prob[:, None])[:, 0]
            behind = _log_forward(length, length - stops, length - starts, log_prob[:, None])[::-1, 0]
            out += np.bincount(piece, counts[rows[0]] * np.exp(ahead[starts] + log_prob + behind[stops] - ahead[-1]), len(prob))
            continue
        arcs = list(lattice.arcs(codes))
        alpha = np.zeros((length + 1, len(rows)))
        beta = np.zeros_like(alpha)
        alpha[0], beta[-1] = 1, 1
        for i, j, at, piece in arcs:
            alpha[j, at] += alpha[i, at] * prob[piece]
        for i, j, at, piece in sorted(arcs, key=lambda a: -a[1]):
            beta[i, at] += prob[piece] * beta[j, at]
        share = counts[rows] / alpha[-1]
        for i, j, at, piece in arcs:
            out += np.bincount(piece, alpha[i, at] * prob[piece] * beta[j, at] * share[at], len(prob))
    return out


@dataclass
class LanguageModel:
    """Languages and, per piece and language, its probability; the last row is the unknown character."""

    languages: list[str]
    lattice: Lattice
    prob: np.ndarray


def fit(docs: DataFrame, vocabulary: str, train: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        sample_docs: int = SAMPLE_DOCS, iterations: int = ITERATIONS) -> LanguageModel:
    """Fit on a sample of about ``sample_docs`` labelled documents a language, chosen by a hash of the id
    among those for which ``train`` holds; null texts and null languages take no part."""
    rows = docs.filter(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = rows.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()
    languages = sorted(r["lang"] for r in sizes)
    pieces = pieces_of(vocabulary)
    lattice = Lattice.of(pieces)
    size = len(pieces) + 1
    prob = np.full((size, len(languages)), 1 / size)
    if not languages:
        return LanguageModel(languages, lattice, prob)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample_docs / r["n"]))])
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(1), F.col(doc_id).cast("string"), F.xxhash64(text)), 11).cast("double") / F.lit(2.0**53)
    sample = rows.filter(draw < F.element_at(share, F.col(lang)))

    def count(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                langs = part.column(0).to_pylist()
                codes, first, distinct = split_words(letter_words(as_strings(part.column(1))))
                where = {x: k for k, x in enumerate(dict.fromkeys(langs))}
                owner = np.repeat([where[x] for x in langs], np.diff(first))
                for x, k in where.items():
                    n = np.bincount(codes[owner == k], minlength=len(distinct))
                    some = np.flatnonzero(n)
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array([x] * len(some), pa.string()), distinct.take(pa.array(some)), pa.array(n[some], pa.int64())],
                                                         names=["lang", "word", "n"])

    words = sample.select(F.col(lang).alias("lang"), F.col(text).cast("string").alias("text")).mapInArrow(count, "lang string, word string, n long")
    words = stored(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")

    for _ in range(iterations):
        step = prob.copy()

        def expect(batches, step=step):
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                langs = np.array(batch.column(0).to_pylist(), object)
                for x in dict.fromkeys(langs):
                    rows = np.flatnonzero(langs == x)
                    made = expected_counts(lattice, step[:, languages.index(x)], batch.column(1).take(pa.array(rows)).to_pylist(),
                                           batch.column(2).to_numpy()[rows].astype(float))
                    total[x] = total.get(x, 0) + made
            for x, made in total.items():
                some = np.flatnonzero(made)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(made[some])],
                                                 names=["lang", "piece", "expected"])

        sums = words.mapInArrow(expect, "lang string, piece int, expected double").groupBy("lang", "piece").agg(F.sum("expected").alias("e"))
        prob = np.full((size, len(languages)), SMOOTHING)
        for r in sums.toLocalIterator():  # at most one row per piece and language
            prob[r["piece"], languages.index(r["lang"])] += r["e"]
        prob /= prob.sum(axis=0)
    return LanguageModel(languages, lattice, prob)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (posterior probability of that language, equal priors, over
    the whole text). ``und`` with score 0 for a text that is null or has no letter, and for all texts
    if no language was learned; ties go to the first language by name. Other columns pass through; columns named like
    the two new ones are replaced; an empty table stays empty."""
    languages, lattice, prob = model.languages, model.lattice, model.prob
    key = (len(prob), float(prob[:, :1].sum()), float((prob * np.arange(1, len(prob) + 1)[:, None]).sum()))

    def score(texts: pa.Array):
        if not languages:
            return [pa.array(["und"] * len(texts), pa.string()), pa.array(np.zeros(len(texts)))]
        cache = _cache(key)
        codes, first, distinct = split_words(letter_words(texts))
        total = np.zeros((len(texts), len(languages)))
        letters = np.zeros(len(texts), bool)
        if len(distinct):
            real = pc.match_substring_regex(distinct, r"\pL").to_numpy(zero_copy_only=False)
            rows = cache.rows(distinct, lambda w: word_scores(lattice, prob, w)) * real[:, None]
            total = sums_by_text(rows[codes], first)
            letters = sums_by_text(real[codes].astype(np.int64), first) > 0
        total -= total.max(axis=1, keepdims=True)
        post = np.exp(total)
        post /= post.sum(axis=1, keepdims=True)
        best = post.argmax(axis=1)
        names = np.where(letters, np.array(languages, object)[best], "und")
        return [pa.array(names, pa.string()), pa.array(np.where(letters, post[np.arange(len(best)), best], 0.0))]

    return with_columns(docs, text, [StructField("lang_pred", StringType()), StructField("score", DoubleType())], score)


_CACHES: dict = {}


def _cache(key) -> WordCache:
    if key not in _CACHES:
        _CACHES.clear()  # one model at a time
        _CACHES[key] = WordCache(CACHED_WORDS)
    return _CACHES[key]
