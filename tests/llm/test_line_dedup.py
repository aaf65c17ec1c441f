"""Line dedup: the perfect hash, and whole results against plain Python."""

import random
from collections import defaultdict

import numpy as np
import pytest

from panelcast.llm import line_dedup
from panelcast.llm.minimal_hash import MinimalHash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def brute(rows, least=3):
    """doc -> (n_lines, n_dropped, text) for rows (doc_id, text), one result a row."""
    docs, last = defaultdict(int), {}
    low = lambda d: -2**63 if d is None else d
    for d, t in rows:
        for k in {_key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                docs[k] += 1
                last[k] = max(last.get(k, low(None)), low(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (docs.get(_key(x), 0) >= least and low(d) < last[_key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_minimal_hash_is_a_bijection():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 30_000):
        high, low = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
        made = MinimalHash.of(high, low)
        assert sorted(made.numbers(high, low).tolist()) == list(range(n))
        assert len(made.words) * 64 <= max(4 * n, 64 * 12)
    same = np.zeros(2, np.uint64)
    with pytest.raises(ValueError):
        MinimalHash.of(same, same)


def _rows(seed=5):
    rng = random.Random(seed)
    common = [f"This line number {i} is found in many documents" for i in range(40)] + ["ÄÖÜ äöü ßßß " * 3, "x" * 19, "Y" * 20, "é" * 20, "  　wide blank is no blank to strip　"]
    hot = "the one line that a third of all documents hold"
    rows = []
    for i in range(400):
        lines = [rng.choice(common) for _ in range(rng.randrange(5))] + [f"own line of document {i} {rng.random()}"]
        lines = [x.upper() if rng.random() < 0.2 else " \t" + x + "\r" if rng.random() < 0.2 else x for x in lines]
        if i % 3 == 0:
            lines += [hot, hot]
        rng.shuffle(lines)
        rows.append((i * 7 - 100, "\n".join(lines)))
    rows += [(None, hot + "\n" + common[0]), (5000, None), (5001, ""), (5002, "\n\n"), (None, None)]
    rows += [(77_777, hot), (77_777, hot), (60, common[1]), (60, common[1]), (60, common[1]), (60, "other\n" + common[1])]
    rows += [(9_000, "\n".join(["a long text says the same again"] * 20_000)), (9_001, "a long text says the same again\nb"), (9_002, "A LONG text says the same again ")]
    return rows


@pytest.mark.parametrize("shard_keys, hot_keys", [(16_384, 10_000), (7, 5), (50, 1)])
def test_equals_brute_force(spark, shard_keys, hot_keys):
    rows = _rows()
    df = spark.createDataFrame([(t, d, 1, "x", 2.0) for d, t in rows], "text string, doc_id long, n_lines int, _id string, lines double").repartition(5)
    out = line_dedup.drop_repeated_lines(df, shard_keys=shard_keys, hot_keys=hot_keys)
    assert out.columns == ["text", "doc_id", "_id", "lines", "n_lines", "n_dropped"]
    got = sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()], key=str)
    assert got == brute(rows)
    assert {(r["_id"], r["lines"]) for r in out.collect()} == {("x", 2.0)}


def test_edge_and_empty(spark, edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    got = sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.drop_repeated_lines(edge).collect()], key=str)
    assert got == brute(rows)
    assert line_dedup.drop_repeated_lines(empty).collect() == []


def test_index_tells_lines_apart(spark):
    high, low = np.arange(1, 5001, dtype=np.uint64), np.arange(1, 5001, dtype=np.uint64) * np.uint64(977)
    index = line_dedup.LineIndex.load(line_dedup.LineIndex.of(high, low, np.arange(5000) % 5, np.arange(5000), 3).dump())
    assert (index.known(high, low) >= 0).all() and not (index.known(high + np.uint64(10**6), low * np.uint64(3) + np.uint64(1)) >= 0).any()
    doc = np.full(5000, 2500)
    assert (index.loses(high, low, doc) == ((np.arange(5000) % 5 >= 3) & (np.arange(5000) > 2500))).all()
