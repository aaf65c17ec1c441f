"""Cross-tokenizer alignment against plain Python with the libraries the ids are defined by."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from panelcast.llm import cross_tokens
from panelcast.llm.cross_tokens import A_VOCABULARY, B_VOCABULARY, ByteTokens, cross_tokenized

from .conftest import SF

PATHS = (public_tokenizers.path(A_VOCABULARY), public_tokenizers.path(B_VOCABULARY))
ODD = ["<|endoftext|> and <s> </s> <unk> <0x41>", "  two  blanks \n\n\t tabs ", "I'll 's 12³ ½", "😀👍🏽 中文字 نص", "▁ the mark itself ▁▁", "\x00\x01 control  ", "á ﬁ",
       "\n", " ", "​", "Ǆ" * 300, "a" + " " * 12_000 + "b"]


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = cross_tokens.byte_letters()

    def a_bytes(i):
        return bytes(letters[c] for c in a.id_to_token(i))

    def b_bytes(i):
        p = b.id_to_piece(i)
        m = re.fullmatch("<0x(..)>", p)
        return bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode()

    made, count = [], Counter()
    for d, t in rows:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        ta, tb = [a_bytes(i) for i in ids_a], [b_bytes(i) for i in ids_b]
        if not t or {b"".join(ta), b"".join(tb)} != {(" " + t).encode()}:
            made.append((d, [], [], [], ""))
            continue
        ends = []
        for parts in (ta, tb):
            at, of = 0, {}
            for k, x in enumerate(parts):
                at += len(x)
                of[at] = k
            ends.append(of)
        links, spelled, pa, pb = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            ka, kb = ends[0][e], ends[1][e]
            links.append((ids_b[kb], ids_a[ka]))
            spelled.append(",".join(map(str, ids_a[pa:ka + 1])) + "|" + ",".join(map(str, ids_b[pb:kb + 1])))
            pa, pb = ka + 1, kb + 1
        count.update(links)
        made.append((d, ids_a, ids_b, links, ";".join(spelled)))
    most = defaultdict(int)
    for (y, _), n in count.items():
        most[y] = max(most[y], n)
    return sorted(((d, len(x), len(y), len(k), len(k), sum(count[p] == most[p[0]] for p in k), sum(count[p] for p in k), g) for d, x, y, k, g in made), key=str)


def _collected(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()), key=str)


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in docs] + [(10_000 + i, x) for i, x in enumerate(ODD)] + [(None, None), (5, ""), (7, "the same"), (7, "the same"), (None, "the same")]


@pytest.fixture(scope="module")
def expected(rows):
    return brute(rows)


def test_equals_brute_force(spark, rows, expected):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, spill int, groups string").repartition(3)
    assert _collected(cross_tokenized(df, *PATHS, spell=True)) == expected
    hashed = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in expected]
    assert _collected(cross_tokenized(df, *PATHS)) == sorted(hashed, key=str)


def test_many_spills_and_merge_rounds_give_the_same(spark, rows, expected):
    small = {"spill_records": 500, "spill_docs": 9}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    runs = cross_tokens.spilled(df, *PATHS, **small).filter("radix is not null")
    salts = cross_tokens._salts(runs, "pairs", 2_000)
    assert max(salts) > 4  # several rounds with a fan-in of 2
    assert _collected(cross_tokenized(df, *PATHS, spell=True, run_bytes=2_000, fan_in=2, **small)) == expected


def test_edge_and_empty(spark, edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert _collected(cross_tokenized(edge, *PATHS, spell=True)) == brute(rows)
    assert cross_tokenized(empty, *PATHS).collect() == []


def test_fast_ids_are_the_files_ids():
    tokens = ByteTokens(PATHS[0])
    texts = [" ".join(chr(c) + "a1" for c in range(i, i + 256) if not 0xD800 <= c < 0xE000) for i in range(0x20, 0x20000, 256)]
    texts += [t.decode() for t in tokens.ranks if t.decode("utf-8", "ignore").encode() == t]
    exact = [tokens.exact.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert tokens.encode(texts) == exact
