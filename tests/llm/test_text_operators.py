"""Text operators against brute force, with the edge rows and empty tables."""

import itertools
import random
import time
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelcast.llm import decontaminate as dec
from panelcast.llm import language_id as lid
from panelcast.llm import mixing, near_dup, repair_tokens, separator_scan, toxicity
from panelcast.llm.words import hash_words, split_words

from .conftest import SF

P = pytest.importorskip("public_tokenizers")


def test_words_and_hashes():
    texts = pa.array(["  a b\xa0c \x0b d\n", "", "a"], pa.string())
    codes, first, distinct = split_words(texts)
    words = [distinct[i].as_py() for i in codes]
    assert words == ["a", "b\xa0c", "d", "a"] and first.tolist() == [0, 3, 3, 4]
    many = pa.array([f"w{i}" for i in range(20_000)] + ["y" * 3_000, "y" * 3_001], pa.string())
    assert len(np.unique(hash_words(many))) == len(many)
    assert hash_words(many.slice(7, 3)).tolist() == hash_words(many)[7:10].tolist()


# ---- language ID

def _segmentations(word, prob):
    if not word:
        return 1.0
    return sum(prob[word[:k]] * _segmentations(word[k:], prob) for k in range(1, len(word) + 1) if word[:k] in prob)


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "bb"]
    lattice = lid.Lattice.of(pieces)
    prob = np.random.default_rng(0).random((len(pieces) + 1, 2)) / 5
    for k in range(2):
        table = {p: prob[i, k] for i, p in enumerate(pieces)}
        for word in ("a", "abab", "bbaba", "ababb"):
            got = lid.word_scores(lattice, prob, [word])[0, k]
            assert got == pytest.approx(np.log(_segmentations("▁" + word, table)))


def test_long_words_are_one_sum():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "bb", "abababababab"]
    lattice = lid.Lattice.of(pieces)
    prob = np.random.default_rng(1).random((len(pieces) + 1, 2)) / 50
    for word in ("ab" * 15 + "a", "ab" * 16, "abbac" * 40, "b" * 3_000):  # the first has 32 characters with its mark
        marked, want, uses = "▁" + word, [], np.zeros(len(prob))
        for k in range(2):
            table = {p: prob[i, k] for i, p in enumerate(pieces)} | {"c": prob[-1, k]}
            sums = [0.0]  # logs of the sums over all segmentations of each prefix
            for j in range(1, len(marked) + 1):
                ways = [sums[i] + np.log(table[marked[i:j]]) for i in range(max(0, j - 12), j) if marked[i:j] in table]
                sums.append(np.logaddexp.reduce(ways))
            want.append(sums[-1])
        assert lid.word_scores(lattice, prob, ["a", word, "b"])[1] == pytest.approx(np.array(want), rel=1e-9)
        uses = lid.expected_counts(lattice, prob[:, 0], [word], np.array([2.0]))
        assert (uses * [len(p) for p in [*pieces, "c"]]).sum() == pytest.approx(2 * len(marked))  # every character once
    plain, lid.PLAIN_WORD = lid.PLAIN_WORD, 0
    try:
        logs = lid.expected_counts(lattice, prob[:, 0], ["abab", "bbaba"], np.array([2.0, 1.0]))
    finally:
        lid.PLAIN_WORD = plain
    assert logs == pytest.approx(lid.expected_counts(lattice, prob[:, 0], ["abab", "bbaba"], np.array([2.0, 1.0])))


def test_expected_counts_match_enumeration():
    pieces = ["▁", "a", "b", "ab", "▁a"]
    lattice, prob = lid.Lattice.of(pieces), np.array([.1, .2, .3, .25, .1, .05])

    def walk(rest):
        if not rest:
            yield []
        for k in range(1, len(rest) + 1):
            if rest[:k] in pieces:
                for more in walk(rest[k:]):
                    yield [rest[:k], *more]

    want, total = np.zeros(6), 0.0
    for seg in walk("▁abab"):
        p = np.prod([prob[pieces.index(x)] for x in seg])
        total += p
        for x in seg:
            want[pieces.index(x)] += p
    got = lid.expected_counts(lattice, prob, ["abab"], np.array([3.0]))
    assert got == pytest.approx(want / total * 3)


def test_language_held_out_accuracy_and_edges(spark, edge, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = lid.fit(docs, P.path(lid.VOCABULARY), ~held, sample_docs=60, iterations=3)
    out = lid.predict(docs.filter(held), model)
    assert out.filter("lang = lang_pred").count() >= 0.95 * out.count() > 0
    rows = lid.predict(edge, model).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3, 4)) for r in rows)
    assert lid.predict(empty, model).count() == 0
    none = lid.fit(empty, P.path(lid.VOCABULARY), F.lit(True))
    assert {r["lang_pred"] for r in lid.predict(edge, none).collect()} == {"und"}


# ---- token files

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.path(repair_tokens.VOCABULARY))


def _encoded(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [repair_tokens.END_ID]


def test_word_encoder_equals_whole_texts(tokenizer):
    texts = ["It's (well-known), 'tis: don't!! é é a̸b x≠ 12345", "A<|endoftext|> b <|ENDOFTEXT|>", "", " 　 İstanbul ΣΑΣ ", "a.b,c;d"]
    rng = random.Random(5)
    texts += ["".join(rng.choice("ab'sE.,!<|>é́ \n\t1½漢😀") for _ in range(60)) for _ in range(200)]
    ids, n = repair_tokens.WordEncoder(P.path(repair_tokens.VOCABULARY)).encode(pa.array(texts, pa.string()))
    for part, text in zip(np.split(ids, np.cumsum(n)[:-1]), texts):
        assert part.tolist() == _encoded(tokenizer, text), text


def test_repair_round_trip():
    rng = np.random.default_rng(3)
    for size, kinds in ((0, 3), (1, 3), (5_000, 3), (5_000, 2_000)):
        ids = rng.integers(0, kinds, size).astype(np.int32)
        starts = np.unique(np.append(0, rng.integers(0, max(size, 1), 40))) if size else np.zeros(0, np.int64)
        pairs, lengths, symbols, per_doc = repair_tokens.compress(ids, starts)
        assert repair_tokens.expand(pairs, lengths, symbols).tolist() == ids.tolist()
        assert per_doc.sum() == len(symbols) and (kinds > 3 or size < 100 or len(symbols) < size / 2)


def test_runs_of_one_symbol_are_replaced():
    ids = np.array([4] * 4099 + [5, 4, 4, 4, 5, 5] * 30, np.int32)
    pairs, lengths, symbols, per_doc = repair_tokens.compress(ids, np.array([0, 1000, 1001, 4099]))
    assert repair_tokens.expand(pairs, lengths, symbols).tolist() == ids.tolist()
    assert (pairs[:, 0] == pairs[:, 1]).any() and len(symbols) < 150 and len(per_doc) == 4
    # no pair is frequent any more
    seq, head = symbols, np.zeros(len(symbols), bool)
    head[np.cumsum(per_doc) - per_doc] = True
    left = Counter((a, b) for a, b, h in zip(seq[:-1].tolist(), seq[1:].tolist(), head[1:]) if not h and a != b)
    assert max(left.values(), default=0) < repair_tokens.LEAST


def test_one_id_is_many_ranges(spark, tokenizer):
    rows = [(7, f"text {k} " * 20) for k in range(300)] + [(None, f"none {k}") for k in range(100)] + [(k, "own") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    from panelcast.session import scratch_path
    path = scratch_path(spark, "ranges")
    repair_tokens.write_tokens(df, path, P.path(repair_tokens.VOCABULARY))
    shards = [(r["shard"], set(r["doc_ids"])) for r in spark.read.parquet(path).collect()]
    assert sum(7 in ids for _, ids in shards) > 5 and sum(None in ids for _, ids in shards) > 1
    got = repair_tokens.read_documents(spark.read.schema(repair_tokens.SCHEMA).parquet(path)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    want = Counter((d, zlib.crc32(np.array(_encoded(tokenizer, t), "<u4").tobytes())) for d, t in rows)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want


def test_token_file(spark, edge, empty, tokenizer):
    got = repair_tokens.token_file(edge, P.path(repair_tokens.VOCABULARY)).orderBy("start").collect()
    rows = sorted(((r["doc_id"], r["text"]) for r in edge.collect()), key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1]))
    start = 0
    for r, (doc, text) in zip(got, rows):
        ids = np.array(_encoded(tokenizer, text), "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(rows) and repair_tokens.token_file(empty, P.path(repair_tokens.VOCABULARY)).count() == 0


def test_random_access(spark, tokenizer):
    from panelcast.session import scratch_path
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = scratch_path(spark, "access")
    repair_tokens.write_tokens(docs, path, P.path(repair_tokens.VOCABULARY))
    row = spark.read.parquet(path).first()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k in (0, 3, len(row["doc_ids"]) - 1):
        assert repair_tokens.decode_document(row, k).tolist() == _encoded(tokenizer, text[row["doc_ids"][k]])


def test_stitching_a_block_of_many_documents(spark):
    """100,000 empty documents in one block: work in proportion to them (each had the whole block's arrays made anew)."""
    n = 100_000
    data = bytearray(np.full(n, separator_scan.END_ID, "<u2").tobytes())
    blocks = spark.createDataFrame([("a", 0, data)], "file string, block int, data binary")
    began = time.time()
    got = separator_scan.stitch(separator_scan.scan_blocks(blocks)).agg(F.count(F.lit(1)), F.sum("n_tokens"), F.max("start"), F.max("ordinal"), F.min("closed")).first()
    assert tuple(got) == (n, 0, n - 1, n - 1, True) and time.time() - began < 60


@pytest.mark.parametrize("block", [2, 6, 1 << 20])
def test_separator_scan_stitches_blocks(spark, block):
    end = separator_scan.END_ID
    files = {"a": [[5, 6], [], [7] * 9, [8]], "b": [[]], "c": [[3] * 4]}
    rows, want = [], set()
    for name, docs in files.items():
        ids = [x for d in docs for x in [*d, end]] + ([9, 9, 9] if name == "c" else [])
        data = np.array(ids, "<u2").tobytes()
        rows += [(name, i, bytearray(data[at:at + block])) for i, at in enumerate(range(0, len(data), block))]
        start = 0
        for k, d in enumerate(docs + ([[9, 9, 9]] if name == "c" else [])):
            want.add((name, k, start, len(d), not (name == "c" and k == 1)))
            start += len(d) + 1
    blocks = spark.createDataFrame(rows, "file string, block int, data binary")
    got = separator_scan.stitch(separator_scan.scan_blocks(blocks))
    assert {tuple(r) for r in got.collect()} == want


def test_token_counts(spark, edge, empty):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=P.path(separator_scan.VOCABULARY))
    got = separator_scan.token_counts(edge, P.path(separator_scan.VOCABULARY), block_bytes=64).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(model.encode(r["text"] or "")) for r in edge.collect())
    assert all(r["closed"] for r in got) and separator_scan.token_counts(empty, P.path(separator_scan.VOCABULARY)).count() == 0


# ---- near duplicates

WORDS = re.compile("[^\x20\x09-\x0D]+")


def _sets(texts, width):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for t in texts:
        w = WORDS.findall((t or "").translate(low))
        yield {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def _components(ids, sets, percent=80):
    of = {i: i for i in ids}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for (i, a), (j, b) in itertools.combinations(zip(ids, sets), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = root(i), root(j)
            of[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(400)}" for _ in range(90)]
    texts = []
    for k in range(150):  # chains of edits: many pairs lie near the threshold
        t = list(base if k % 3 else [f"v{rng.randrange(99)}" for _ in range(30)])
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += [texts[0]] * 5 + [texts[1].upper(), None, "", " ", "solo", "SOLO", "two words"]
    ids = [1000 - 3 * k for k in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    sets = list(_sets(texts, 2))
    want = _components(ids, sets)
    got = near_dup.near_duplicates(df, width=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(ids)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in zip(ids, sets)}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_edges(spark, edge, empty):
    got = near_dup.near_duplicates(edge).collect()
    assert len(got) == 10 and near_dup.near_duplicates(empty).count() == 0
    of = {r["doc_id"]: r["component_id"] for r in got}
    assert of[5] == of[6] == 5 and all(of[k] == k for k in (1, 2, 3, 4, 7, 8)) and of[None] is None


def test_components_of_a_long_path(spark):
    from panelcast.llm.components import connected_components
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 99), (100, 100), (None, 3)], "a long, b long")
    got = {r["node"]: r["component_id"] for r in connected_components(links, "a", "b").collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 99: 99, 100: 99}


# ---- decontamination

def _items(spark):
    rng = random.Random(2)
    texts = [" ".join(f"q{rng.randrange(3000)}" for _ in range(n)) + " the of and" for n in (6, 20, 40, 64, 150, 1)]
    return texts, spark.createDataFrame(list(enumerate(texts)) + [(None, "null id " * 9), (77, None)], "item_id long, text string")


def test_planted_items_are_found(spark, edge, empty):
    texts, items = _items(spark)
    rng = random.Random(3)
    noise = lambda n: " ".join(f"n{rng.randrange(5000)} the of" for _ in range(n))
    rows = [(k, f"{noise(k * 37)} {t.upper().replace(' ', ',  ') if k % 2 else t} {noise(50)}") for k, t in enumerate(texts)]
    rows += [(100 + k, noise(400)) for k in range(5)] + [(200, " ".join(texts[2].split()[:20]))]
    got = dec.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(k, k) for k in range(6)}  # item 5 has four words: one shingle
    assert dec.contaminated(edge, items).count() == 0 == dec.contaminated(empty, items).count()
    assert dec.decontaminate(edge, items).count() == 10 == dec.decontaminate(edge, items.filter("false")).count()
    assert dec.contaminated(edge, items.filter("false")).count() == 0


def test_items_under_five_words_must_occur_whole(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta"), (3, " ,; "), (4, "alpha beta alpha beta")], "item_id long, text string")
    rows = [(10, "x Alpha, beta gamma y"), (11, "alpha gamma beta"), (12, "one DELTA two"), (13, "deltas"), (14, "alpha beta alpha beta"), (15, "gamma"), (16, None)]
    got = dec.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(10, 1), (12, 2), (14, 4)}


def test_block_max_wand_retrieves_all_above_the_threshold(spark):
    rng = np.random.default_rng(4)
    items = [(i, " ".join(f"t{int(x)}" for x in rng.zipf(1.3, 30) % 200), None) for i in range(60)]
    units, words = dec.units_of(items)
    pairs = [np.unique(w, return_counts=True) for w in words]
    term, tf = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]).astype(float)
    unit = np.repeat(np.arange(len(units)), [len(p[0]) for p in pairs])
    kinds, n = np.unique(term, return_counts=True)
    index = dec.Index(units, term, unit, tf, n[np.searchsorted(kinds, term)].astype(float), np.array([len(w) for w in words], float), len(units), 30.0)
    for _ in range(60):
        query = np.unique(rng.integers(0, len(index.terms), 40))
        score = np.zeros(len(units))
        for t in query:
            np.add.at(score, index.unit[index.first[t]:index.first[t + 1]], index.share[index.first[t]:index.first[t + 1]])
        got = index.retrieve(query)
        assert {u for u, _ in got} == set(np.flatnonzero(score >= 1).tolist())
        assert all(s == pytest.approx(score[u]) for u, s in got)


def test_small_indexes_find_the_same(spark):
    texts, items = _items(spark)
    docs = spark.createDataFrame([(1, texts[2]), (2, texts[3] + " " + texts[0])], "doc_id long, text string")
    found = [sorted((i, h["item_id"]) for index in dec.build_indexes(items, index_bytes=size)
                    for i, hits in dec.find_items(docs, index).select("doc_id", "benchmark_hits").collect() for h in hits) for size in (1 << 20, 300)]
    assert found[0] == found[1] == [(1, 2), (2, 0), (2, 3)]


def test_one_changed_word_in_each_position(spark):
    words = [f"q{k}" for k in range(40)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    rows = [(k, " ".join(["before", *words[:k], "changed", *words[k + 1:], "after"])) for k in range(40)]
    got = {r["doc_id"]: r for r in dec.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert sorted(got) == list(range(40))
    assert all(r["question_overlap"] == (36 - min(k + 1, 40 - k, 5)) / 36 and r["answer_overlap"] is None for k, r in got.items())


def test_question_and_answer_are_verified_apart(spark):
    words = [f"q{k}" for k in range(40)]
    items = spark.createDataFrame([(1, " ".join(words[:30]), " ".join(words[30:]))], "item_id long, text string, answer string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:34], "changed", *words[35:]]))], "doc_id long, text string")
    index, = dec.build_indexes(items, answer="answer")
    got = {r["doc_id"]: r["benchmark_hits"] for r in dec.find_items(docs, index).collect()}
    assert [(h["question_overlap"], h["answer_overlap"]) for h in got[1]] == [(1.0, 1.0)] and got[2] == []


@pytest.mark.parametrize("size", [64, 65, 400])
def test_long_items_are_verified_whole(spark, size):
    words = [f"q{k}" for k in range(size)]
    cut = size - size // 4
    other = [f"n{k}" for k in range(150)]
    inserted = [x for k, w in enumerate(words) for x in ([w, "new"] if k % 30 == 29 else [w])]
    changed = ["other" if k % 40 == 20 else w for k, w in enumerate(words)]
    texts = {1: words, 2: inserted, 3: changed, 4: words[:33], 5: words[:size // 2], 6: words[:cut], 7: words[cut:],
             8: [*words[:cut], *(f"a{k}" for k in range(size // 4))]}
    rows = [(10 * k + n, " ".join([*other[:n * 37], *t, *other])) for k, t in texts.items() for n in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    parts = spark.createDataFrame([(1, " ".join(words[:cut]), " ".join(words[cut:]))], "item_id long, text string, answer string")

    def shares(part, text):
        have = {tuple(text[k:k + 5]) for k in range(len(text))}
        return np.mean([tuple(part[k:k + 5]) in have for k in range(len(part) - 4)])

    for index, pieces in ((dec.build_indexes(whole)[0], [words]), (dec.build_indexes(parts, answer="answer")[0], [words[:cut], words[cut:]])):
        got = {r["doc_id"]: r["benchmark_hits"] for r in dec.find_items(docs, index).collect()}
        for k, t in texts.items():
            want = [shares(p, t) for p in pieces]
            for n in range(4):
                assert bool(got[10 * k + n]) == (min(want) >= dec.OVERLAP), (k, n)
                for h in got[10 * k + n]:
                    assert [h["question_overlap"], h["answer_overlap"]][:len(want)] == pytest.approx(want)
        assert got[10] and not got[40] and not got[50] and not got[70]


# ---- toxicity

def _kernel(s, t, order, decay):
    total = 0.0
    for a in itertools.combinations(range(len(s)), order):
        for b in itertools.combinations(range(len(t)), order):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_subsequence_kernel_matches_enumeration():
    words = ["idiot", "idxiot", "abcabc", "ab", "toidi", ""]
    got = toxicity.subsequence_kernel(words, words[:5])
    for i, s in enumerate(words):
        for j, t in enumerate(words[:5]):
            assert got[i, j] == pytest.approx(_kernel(s, t, toxicity.ORDER, toxicity.DECAY), rel=1e-5)
    assert toxicity._self_kernel(words[:5]) == pytest.approx(np.diag(got[:5]), rel=1e-5)


def test_toxicity_tolerates_insertions(spark, edge, empty):
    rng = random.Random(9)
    clean = lambda: " ".join("".join(rng.choice("aeioulmnr") for _ in range(rng.randrange(2, 9))) for _ in range(40))
    docs, labels = [], []
    for k in range(240):
        bad = k % 4 == 0
        docs.append((k, clean() + (f" {rng.choice(['stupid', 'worthless', 'pathetic'])}. " if bad else " ") + clean()))
        labels.append((k, int(bad)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"), F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert all(got[k]["predicted"] == y for k, y in labels if k % 5 == 0)
    probe = spark.createDataFrame(list(enumerate(["you wor.th-less one", "stu*pid", "so s t u p i d now", "path-etic", "stuxpid", "laman rolin", "", None])),
                                  "doc_id long, text string")
    flags = [r["predicted"] for r in toxicity.score(probe, model).orderBy("doc_id").collect()]
    assert flags == [1, 1, 1, 1, 1, 0, 0, 0]
    rows = toxicity.score(edge, model).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows) and toxicity.score(empty, model).count() == 0
    assert toxicity.score(edge, toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))).count() == 10


# ---- mixing

def test_shares_stop_at_three_sizes():
    assert mixing.share_out([10, 10, 10], [5, 2, 1]) == [18.75, 7.5, 3.75]
    got = mixing.share_out([2, 100, 30], [5, 2, 1])
    assert got[0] == 6 and got[1] == pytest.approx(84) and got[2] == pytest.approx(42) and sum(got) == pytest.approx(132)
    assert mixing.share_out([], []) == [] and mixing.share_out([0, 0], [5, 2]) == [0, 0]


def test_mix_meets_targets(spark, edge, empty):
    rng = random.Random(1)
    rows = [(k, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 30))), rng.choice(["s0", "s0", "s0", "b", "c", None])) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (mixing.mix(x, rows_per_bucket=50).drop("tie").orderBy("doc_id").collect() for x in (df, df.repartition(7)))
    assert a == b and len(a) == 900
    assert all(r["size"] == len(WORDS.findall(t)) and r["taken"] <= 3 * r["size"] for r, (_, t, _) in zip(a, rows))
    for s in ("s0", "b", "c", None):
        mine = [r for r in a if r["source"] == s]
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 15.01  # half of the largest document
        assert {r["epochs"] for r in mine if r["size"]} <= {int(mine[0]["target"] // mine[0]["source_size"]) + k for k in (0, 1)}
    out = mixing.mix(edge).collect()
    assert len(out) == 10 and mixing.mix(empty).count() == 0
    both = mixing.mixed_rows(edge)
    assert both.columns == edge.columns and both.count() == sum(r["epochs"] for r in out)


def test_quality_weights_raise_the_chance(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    out = mixing.mix(df, quality=mixing.quality_weights(labels), weights=(5, 2)).filter("source = 'b'")
    shares = {r["q"]: r["s"] for r in out.groupBy((F.col("doc_id") % 2).alias("q")).agg(F.avg("epochs").alias("s")).collect()}
    assert shares[1] > shares[0] * 1.3


def test_word_count(spark):
    texts = ["  a b\xa0c \x0b d\n", "", None, "\x1c a", "a\r\nb\x0cc"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(F.col("t"))).collect()]
    assert got == [len(WORDS.findall(t or "")) for t in texts]
