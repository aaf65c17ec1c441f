"""Toxicity by a subsequence string kernel and a support vector machine.

The kernel of two words sums over all common subsequences of ORDER characters, each
weighted by DECAY to the span it takes in either word, and is normalised. A word with
inserted characters shares most subsequences with the clean word, only over longer spans.
Words are mapped to Nystroem features (kernel values against landmark words times the
inverse root of the landmarks' kernel matrix) and a linear machine is trained on them;
a sentence, and a document, is as toxic as its worst word.

Only whole texts are labelled. On a bounded sample, character grams that occur almost only in toxic
texts name the words that may carry the label and choose the landmarks; a first machine is trained on these
words (with inserted characters, too) against words of clean texts, and again with the clean words it scores highest.
Then it is trained on the labelled texts: each text stands by the word that the machine scores highest, with the
text's label, and both steps repeat.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from panelcast.llm.near_dup import minima, shingle_sets
from panelcast.llm.scratch import stored
from panelcast.llm.words import WordCache, as_strings, chunks, letter_words, max_by_text, split_words, with_columns

ORDER, DECAY = 3, 0.6
#: Longer words are scored in overlapping parts of this many characters.
MAX_WORD = 24
#: Expected labelled documents of each class that the machine is fitted on.
SAMPLE_DOCS = 2_500
#: Ids that are broadcast at most (some 16 bytes each); more are joined by shuffling.
MOST_BROADCAST = 100_000
LANDMARKS_TOXIC, LANDMARKS_CLEAN = 48, 16
GRAMS = (4, 5, 6)
#: A gram names toxic words from this share of its (class-balanced) documents and likelihood ratio on.
PRECISION, EVIDENCE = 0.9, 25.0
POSITIVES, NEGATIVES = 1_500, 6_000
#: Rounds of training on the labelled texts, and the weight of a text against that of a word.
TEXT_ROUNDS, TEXT_COST = 2, 2.0
CACHED_WORDS = 500_000
#: Entries of a value table that is indexed by the characters directly; larger ones are searched.
MOST_DENSE = 1 << 20


def _codes(words: Sequence[str], width: int) -> np.ndarray:
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)


def subsequence_kernel(words: Sequence[str], others: Sequence[str]) -> np.ndarray:
    """Kernel of every word with every other word (not normalised)."""
    if not len(words) or not len(others):
        return np.zeros((len(words), len(others)))
    s = _codes(words, max(1, max(map(len, words))))
    t = _codes(others, max(1, max(map(len, others))))
    n, m, width = len(s), len(t), t.shape[1]
    # step[b', b] = DECAY**(b - b') for b' <= b: gaps in the other word
    gap = np.triu(DECAY ** np.maximum(0, np.arange(width)[None, :] - np.arange(width)[:, None])).astype(np.float32)
    # before[i][:, :, b]: subsequences of i characters that end before position b of the other word, decayed up to it
    before = [np.ones((n, m, width), np.float32)] + [np.zeros((n, m, width), np.float32) for _ in range(ORDER - 1)]
    total = np.zeros((n, m), np.float32)
    for a in range(s.shape[1]):
        same = (s[:, a, None, None] == t[None]) & (s[:, a] != 0)[:, None, None]
        if not same.any():
            for i in range(1, ORDER):
                before[i] *= DECAY
            continue
        met = [np.where(same, before[i], 0) * np.float32(DECAY**2) for i in range(ORDER)]
        total += met[ORDER - 1].sum(axis=2)
        for i in range(1, ORDER):
            # a character at b counts for positions behind b
            ended = (met[i - 1].reshape(-1, width) @ gap).reshape(n, m, width)
            before[i] *= DECAY
            before[i][:, :, 1:] += ended[:, :, :-1]
    return total.astype(np.float64)


def _self_kernel(words: Sequence[str]) -> np.ndarray:
    out = np.zeros(len(words))
    by: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by.setdefault(len(w), []).append(k)
    for width, rows in by.items():
        if width < ORDER:
            continue
        s = _codes([words[k] for k in rows], width)
        gap = np.triu(DECAY ** np.maximum(0, np.arange(width)[None, :] - np.arange(width)[:, None])).astype(np.float32)
        before = [np.ones((len(rows), width), np.float32)] + [np.zeros((len(rows), width), np.float32) for _ in range(ORDER - 1)]
        total = np.zeros(len(rows))
        for a in range(width):
            same = s[:, a, None] == s
            met = [np.where(same, before[i], 0) * np.float32(DECAY**2) for i in range(ORDER)]
            total += met[ORDER - 1].sum(axis=1)
            for i in range(1, ORDER):
                ended = met[i - 1] @ gap
                before[i] *= DECAY
                before[i][:, 1:] += ended[:, :-1]
        out[rows] = total
    return out


def normalised_kernel(words: Sequence[str], others: Sequence[str], others_self: np.ndarray) -> np.ndarray:
    own = np.sqrt(np.outer(_self_kernel(words), others_self))
    out = subsequence_kernel(words, others)
    return np.divide(out, own, out=np.zeros_like(out), where=own > 0)


def parts_of(word: str) -> list[str]:
    word = word.replace("\0", "")
    if len(word) <= MAX_WORD:
        return [word]
    return [word[i:i + MAX_WORD] for i in range(0, len(word) - MAX_WORD // 2, MAX_WORD // 2)]


@cache
def _places(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of ORDER characters of a word, and the decay of the span of each."""
    places = np.array(list(combinations(range(width), ORDER)), np.int64).reshape(-1, ORDER)
    return places, DECAY ** (places[:, -1] - places[:, 0] + 1.0)


def _joined(code: np.ndarray, places: np.ndarray, base: int) -> np.ndarray:
    key = code[:, places[:, 0]].astype(np.int64)
    for k in range(1, ORDER):
        key = key * base + code[:, places[:, k]]
    return key


@dataclass
class ToxicModel:
    """Landmarks, their weights in a word's margin, bias, and the scale from a margin to a probability."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    table: tuple | None = field(default=None, repr=False, compare=False)

    def margins(self, words: Sequence[str]) -> np.ndarray:
        """Margin of each word: the largest of its parts. The kernel is a scalar product over subsequences of
        ORDER characters, so the weighted sum over the landmarks is one value for each such
        subsequence, and a word adds up the values of its own."""
        out = np.full(len(words), -np.inf)
        rows, parts = [], []
        for k, w in enumerate(words):
            for p in parts_of(w):
                rows.append(k)
                parts.append(p)
        values = self._values()
        by: dict[int, list[int]] = {}
        for i, p in enumerate(parts):
            by.setdefault(len(p), []).append(i)
        rows = np.array(rows, np.int64)
        for width, all_ in by.items():
            if width < ORDER:
                np.maximum.at(out, rows[all_], self.bias)
                continue
            places, decay = _places(width)
            most = max(1, (1 << 20) // len(places))
            for at in range(0, len(all_), most):
                some = all_[at:at + most]
                held = [parts[i] for i in some]
                met = values(_codes(held, width), places) @ decay
                own = np.sqrt(_self_kernel(held))
                np.maximum.at(out, rows[some], self.bias + np.divide(met, own, out=np.zeros(len(met)), where=own > 0))
        return out

    def _values(self):
        """Function (character codes of words, places of subsequences) -> value of each subsequence."""
        if self.table is None:
            letters = np.unique(_codes(self.landmarks, max(1, max(map(len, self.landmarks), default=1))))
            letters = letters[letters > 0]
            base = len(letters) + 1  # 0 for characters of no landmark
            keys, sums = [], []
            for w, v, k in zip(self.landmarks, self.weights, _self_kernel(self.landmarks)):
                if len(w) >= ORDER and k > 0:
                    places, decay = _places(len(w))
                    code = np.searchsorted(letters, _codes([w], len(w)))[0] + 1
                    keys.append(_joined(code[None], places, base)[0])
                    sums.append(decay * v / np.sqrt(k))
            key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            kept, at = np.unique(key, return_inverse=True)
            total = np.bincount(at, np.concatenate(sums), len(kept)) if keys else np.zeros(0)
            dense = None
            if base**ORDER <= MOST_DENSE:
                dense = np.zeros(base**ORDER)
                dense[kept] = total
            self.table = letters, base, kept, total, dense
        letters, base, kept, total, dense = self.table

        def values(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
            at = np.searchsorted(letters, codes) if len(letters) else np.zeros(codes.shape, np.int64)
            code = np.where(letters[np.minimum(at, len(letters) - 1)] == codes, at + 1, 0) if len(letters) else at
            key = _joined(code, places, base)
            if dense is not None:
                return dense[key]
            spot = np.minimum(np.searchsorted(kept, key), len(kept) - 1)
            return np.where(kept[spot] == key, total[spot], 0.0)

        return values

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


_SPACED = re.compile(r"(?:(?<=\s)|^)[^\W_](?:\s[^\W_](?=\s|$)){3,}")


def instances(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text as ``split_words`` gives them: lower-cased runs of letters and digits; texts with
    marks inside words (``i.d-i.o.t``) also give these words without the marks, and
    runs of single characters (``i d i o t``) also count joined."""
    runs = letter_words(texts, digits=True)
    inner = pc.match_substring_regex(texts, r"[\pL\pN][^\pL\pM\pN\s]+[\pL\pN]")
    spaced = pc.match_substring_regex(runs, r"(^|\s)[\pL\pN](\s[\pL\pN]){3,}(\s|$)")
    if pc.any(pc.or_(inner, spaced)).as_py():
        bare = pc.utf8_lower(pc.replace_substring_regex(texts, r"[^\pL\pM\pN\s]+", ""))
        runs = pc.if_else(inner, pc.binary_join_element_wise(runs, bare, " "), runs)
        at = np.flatnonzero(spaced.to_numpy(zero_copy_only=False))
        if len(at):
            made = runs.to_pylist()
            for i in at:
                made[i] += " " + " ".join(re.sub(r"\s", "", m) for m in _SPACED.findall(made[i]))
            runs = pa.array(made, pa.string())
    return split_words(runs)


def _grams(word: str) -> set[str]:
    w = f"^{word[:MAX_WORD]}$"
    return {w[i:i + n] for n in GRAMS for i in range(len(w) - n + 1)}


def _evidence(toxic, clean, n_toxic: float, n_clean: float):
    """(share of toxic at equal class sizes, signed likelihood ratio) of a count pair."""
    a, b = toxic / n_toxic, clean / n_clean
    share = a / np.maximum(a + b, 1e-300)
    both = toxic + clean
    e_t, e_c = both * n_toxic / (n_toxic + n_clean), both * n_clean / (n_toxic + n_clean)
    g = 2 * (toxic * np.log(np.maximum(toxic, 1e-9) / e_t) + clean * np.log(np.maximum(clean, 1e-9) / e_c))
    return share, np.where(a > b, g, -g)


def _train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5) -> np.ndarray:
    """Primal Newton steps for the squared hinge; the last coefficient is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pen = ridge * weight.sum() * np.eye(x.shape[1])
    pen[-1, -1] = 1e-9
    for _ in range(50):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve(pen + (xa * wa[:, None]).T @ xa, (xa * wa[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic slope and offset of the label on the margin, with smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -50, 50)))
        grad = x.T @ (weight * (p - target)) + 1e-6 * b
        hess = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b = b - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 1e-6)), float(b[1])


def _with_insertions(words: Sequence[str]) -> list[str]:
    """Each word with one character put in, at a place and of a kind that follow from the word."""
    out = []
    for k, w in enumerate(words):
        rng = np.random.Generator(np.random.PCG64([k, len(w), sum(map(ord, w))]))
        if len(w) > 3:
            at = int(rng.integers(1, len(w)))
            out.append(w[:at] + "xqzwvk"[int(rng.integers(6))] + w[at:])
    return out


def _without_copies(sample: DataFrame) -> DataFrame:
    """(y, text) of the sample without most near copies, whose words would all look telling: a document
    stays if it is the first of those that share any of four minima over its shingles."""

    def least(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(as_strings(part.column(2)), 2)
                made = [minima(s)[:4].astype(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.list_(pa.int64()))], names=["_id", "y", "text", "minima"])

    rows = sample.select(F.col("_id").cast("string").alias("_id"), "y", "text").mapInArrow(least, "_id string, y int, text string, minima array<long>")
    rows = stored(rows.withColumn("_id", F.struct("_id", F.xxhash64("text").alias("h"))), "toxic-minima")
    firsts = (rows.select("_id", F.posexplode("minima").alias("k", "m")).groupBy("k", "m").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n"))
              .filter("n > 1"))
    later = (rows.select("_id", F.posexplode("minima").alias("k", "m")).join(firsts, ["k", "m"]).filter("_id <> first").select("_id").distinct())
    return rows.join(later, "_id", "left_anti").select("y", "text")


def fit(docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text",
        toxic: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> ToxicModel:
    """Fit on about ``sample_docs`` labelled documents a class (by a hash of the id) for which ``train``
    holds. Null labels and texts take no part; of repeated labels of one id the largest counts."""
    given = labels.filter(F.col(toxic).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(toxic).cast("int").alias("y"))
    usable = docs.filter(train & F.col(text).isNotNull())
    # ids and labels alone are joined; texts are read for the few ids drawn
    known = stored(usable.select(F.col(doc_id).alias("_id")).join(given, "_id"), "toxic-ids")
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:  # nothing to tell apart
        return ToxicModel([], np.zeros(0), 0.0, 1.0, -5.0 if 1 not in sizes else 5.0)
    share = F.when(F.col("y") == 1, min(1.0, sample_docs / sizes[1])).otherwise(min(1.0, sample_docs / sizes[0]))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(6), F.col("_id").cast("string")), 11).cast("double") / F.lit(2.0**53)
    drawn = stored(known.filter(draw < share).distinct(), "toxic-drawn")
    if drawn.count() <= MOST_BROADCAST:
        drawn = F.broadcast(drawn)
    rows = usable.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")).join(drawn, "_id")
    sample = stored(_without_copies(rows), "toxic-sample")

    def count(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                y = part.column(0).to_numpy()
                codes, first, distinct = instances(as_strings(part.column(1)))
                owner = np.repeat(np.arange(len(y)), np.diff(first))
                seen = np.unique(owner * np.int64(len(distinct) or 1) + codes)
                word, label = seen % (len(distinct) or 1), y[seen // (len(distinct) or 1)]
                t, c = (np.bincount(word[label == k], minlength=len(distinct)) for k in (1, 0))
                yield pa.RecordBatch.from_arrays([distinct, pa.array(t, pa.int64()), pa.array(c, pa.int64())], names=["word", "t", "c"])

    words = sample.mapInArrow(count, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    words = stored(words.filter(F.length("word") >= ORDER), "toxic-words")
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_t, n_c = max(n.get(1, 0), 1), max(n.get(0, 0), 1)

    def grams(batches):
        for batch in batches:
            sums: dict[str, list[int]] = {}
            for w, t, c in zip(*(x.to_pylist() for x in batch.columns)):
                for g in _grams(w):
                    s = sums.setdefault(g, [0, 0])
                    s[0] += t
                    s[1] += c
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s[0] for s in sums.values()], pa.int64()),
                                              pa.array([s[1] for s in sums.values()], pa.int64())], names=["gram", "t", "c"])

    of = words.mapInArrow(grams, "gram string, t long, c long").groupBy("gram").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # a feature of the method: the grams with most evidence, at most a few thousand
    of = of.filter((F.col("t") / n_t) >= PRECISION * (F.col("t") / n_t + F.col("c") / n_c)).orderBy(F.desc("t"), "gram").limit(4_000).collect()
    t, c = np.array([r["t"] for r in of], float), np.array([r["c"] for r in of], float)
    share, g = _evidence(t, c, n_t, n_c) if len(of) else (np.zeros(0), np.zeros(0))
    telling = {r["gram"]: float(x) for r, s, x in zip(of, share, g) if s >= PRECISION and x >= EVIDENCE}

    some = words.filter((F.col("t") > 0) & (F.col("t") / n_t >= PRECISION * (F.col("t") / n_t + F.col("c") / n_c)))
    some = some.orderBy(F.desc("t"), "word").limit(40 * POSITIVES).collect()
    named = {r["word"]: (max((telling.get(x, 0) for x in _grams(r["word"])), default=0), r["t"]) for r in some}
    toxic_words = sorted((w for w, (e, _) in named.items() if e > 0), key=lambda w: (-named[w][0] - named[w][1], w))[:POSITIVES]
    if not toxic_words:
        return ToxicModel([], np.zeros(0), 0.0, 1.0, float(np.log(sizes[1] / sizes[0])))
    landmarks, covered = [], set()
    for w in toxic_words:
        mine = sorted((x for x in _grams(w) if x in telling), key=lambda x: (-telling[x], x))
        # one word for each telling stem: the word's strongest gram is not in a landmark yet
        if mine[0] not in covered and len(landmarks) < LANDMARKS_TOXIC:
            landmarks.append(w[:MAX_WORD])
            covered.update(mine)
    usual = words.filter((F.col("c") > 0) & (F.length("word") >= 4)).orderBy(F.desc("c"), "word").limit(LANDMARKS_CLEAN).collect()
    landmarks = list(dict.fromkeys(landmarks + [r["word"][:MAX_WORD] for r in usual]))
    own = _self_kernel(landmarks)
    values, vectors = np.linalg.eigh(normalised_kernel(landmarks, landmarks, own) + 1e-6 * np.eye(len(landmarks)))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T

    clean = words.filter("c > 0")
    pick = clean.orderBy(F.xxhash64("word"), "word").limit(NEGATIVES).collect()
    negatives = {r["word"][:MAX_WORD] for r in pick} | {r["word"][:MAX_WORD] for r in usual}
    bad = [w[:MAX_WORD] for w in toxic_words]
    weight = [1.0 + np.log1p(named[w][1]) for w in toxic_words]
    gapped = _with_insertions(bad)
    model = ToxicModel(landmarks, np.zeros(len(landmarks)), -1.0)
    for _ in range(2):
        negatives -= set(bad)
        good = sorted(negatives)
        x = np.concatenate([normalised_kernel(part, landmarks, own) @ root for lot in (bad, gapped, good)
                            for part in (lot[i:i + 512] for i in range(0, len(lot), 512))])
        y = np.array([1.0] * (len(bad) + len(gapped)) + [-1.0] * len(good))
        cost = np.array(weight + [1.0] * len(gapped) + [1.0] * len(good))
        cost[y > 0] *= max(1.0, len(good) / max(1, len(bad) + len(gapped)) / 4)
        w = _train_svm(x, y, cost)
        model = ToxicModel(landmarks, root @ w[:-1], float(w[-1]))

        def hard(batches, model=model):
            for batch in batches:
                m = model.margins(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m)], names=["word", "margin"])

        close = clean.select("word").mapInArrow(hard, "word string, margin double").filter("margin > -1")
        negatives |= {r["word"][:MAX_WORD] for r in close.orderBy(F.desc("margin"), "word").limit(NEGATIVES).collect()}

    # the labelled texts themselves: each stands by its worst word, the machine is trained on these by the texts' labels
    for _ in range(TEXT_ROUNDS):

        def witnesses(batches, model=model):
            for batch in batches:
                for part in chunks(batch, "text"):
                    codes, first, distinct = instances(as_strings(part.column(1)))
                    words = distinct.to_pylist()
                    m = model.margins(words) if words else np.zeros(0)
                    worst = [words[codes[a:b][np.argmax(m[codes[a:b]])]] if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(worst, pa.string())], names=["y", "word"])

        seen = sample.mapInArrow(witnesses, "y int, word string").filter("word is not null").collect()  # a word a text of the bounded sample
        texts_y = np.array([1.0 if r["y"] == 1 else -1.0 for r in seen])
        worst = [_worst_part(model, r["word"]) for r in seen]
        lots = (bad, gapped, sorted(negatives - set(bad)), worst)
        x = np.concatenate([normalised_kernel(part, landmarks, own) @ root for lot in lots for part in (lot[i:i + 512] for i in range(0, len(lot), 512))])
        y = np.concatenate([np.ones(len(bad) + len(gapped)), -np.ones(len(lots[2])), texts_y])
        cost = np.concatenate([weight, np.ones(len(gapped) + len(lots[2])), np.full(len(seen), TEXT_COST)])
        w = _train_svm(x, y, cost)
        model = ToxicModel(landmarks, root @ w[:-1], float(w[-1]))

    def margins(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_document_margins(model, as_strings(part.column(1))))], names=["y", "margin"])

    got = sample.mapInArrow(margins, "y int, margin double").collect()  # the bounded sample, two numbers a document
    y, m = np.array([r["y"] for r in got]), np.array([r["margin"] for r in got])
    model.slope, model.offset = _platt(m, y, np.where(y == 1, sizes[1] / n_t, sizes[0] / n_c))
    return model


def _worst_part(model: ToxicModel, word: str) -> str:
    parts = parts_of(word)
    return parts[0] if len(parts) == 1 else parts[int(np.argmax(model.margins(parts)))]


def _document_margins(model: ToxicModel, texts: pa.Array, cache: WordCache | None = None) -> np.ndarray:
    codes, first, distinct = instances(texts)
    if not len(distinct) or not model.landmarks:
        return np.full(len(texts), model.bias)
    margin = cache.rows(distinct, model.margins) if cache else model.margins(distinct.to_pylist())
    return max_by_text(margin[codes], first, model.bias)


def score(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on). Null, empty and word-free texts
    get the score of a text without any evidence. Other columns pass through, columns named
    like the new ones are replaced, an empty table stays empty."""
    key = (tuple(model.landmarks), model.bias, float(model.weights.sum()))

    def work(texts: pa.Array):
        if key not in _CACHES:
            _CACHES.clear()  # one model at a time
            _CACHES[key] = WordCache(CACHED_WORDS)
        p = model.probability(_document_margins(model, texts, _CACHES[key]))
        return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

    return with_columns(docs, text, [StructField("score", DoubleType()), StructField("predicted", IntegerType())], work)


_CACHES: dict = {}
