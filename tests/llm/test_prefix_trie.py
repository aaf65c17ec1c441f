"""Tree contraction and the conversation trie against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from panelcast.llm import prefix_trie
from panelcast.llm.tree_contraction import subtree_totals


def _totals(up, value):
    total = dict(value)
    depth = {}
    for v in up:
        d, x = 0, v
        while up.get(x) is not None and up[x] in up:
            d, x = d + 1, up[x]
        depth[v] = d
    for v in sorted(up, key=depth.get, reverse=True):
        if up[v] in total and up[v] is not None:
            total[up[v]] += total[v]
    return total


def _forest(kind, n, rng):
    if kind == "path":
        up = {i: i - 1 if i else None for i in range(n)}
    elif kind == "star":
        up = {i: 0 if i else None for i in range(n)}
    elif kind == "caterpillar":
        up = {i: max(i - 2, 0) if i % 2 else i - 2 if i else None for i in range(n)}
    elif kind == "random":
        up = {i: rng.randrange(i) if i else None for i in range(n)}
    elif kind == "chains":  # long unary runs that branch now and then
        up = {i: None if not i else i - 1 if rng.random() < 0.9 else rng.randrange(i) for i in range(n)}
    else:  # several roots, one of them hanging on a node that is not there
        up = {i: None if i % 50 == 0 else i - 1 if i % 3 else i // 50 * 50 for i in range(n)}
        up[100] = 10**6
    ids = rng.sample(range(10**5), n)
    return {ids[i]: (ids[u] if u is not None and u < n else u) for i, u in up.items()}


@pytest.mark.parametrize("kind", ["path", "star", "caterpillar", "random", "chains", "forest"])
def test_totals_of_any_shape(spark, kind):
    rng = random.Random(kind)
    up = _forest(kind, 150, rng)
    value = {v: rng.randrange(-5, 100) for v in up}
    df = spark.createDataFrame([(v, u, value[v], 1) for v, u in up.items()], "v long, u long, x int, one long").repartition(3)
    got = {r["v"]: (r["x"], r["one"]) for r in subtree_totals(df, "v", "u", ["x", "one"]).collect()}
    a, b = _totals(up, value), _totals(up, dict.fromkeys(up, 1))
    assert got == {v: (a[v], b[v]) for v in up}


def test_nothing_and_circles(spark):
    df = spark.createDataFrame([(1, 2, 5), (2, 1, None)], "v long, u long, x int")
    assert subtree_totals(df.filter("false"), "v", "u", ["x"]).collect() == []
    assert sorted(map(tuple, subtree_totals(df.filter("v = 2"), "v", "u", ["x"]).collect())) == [(2, 0)]
    with pytest.raises(ValueError):
        subtree_totals(df, "v", "u", ["x"])


def brute(rows):
    """Rows of the trie for (conv_id, turn, role, text); turns of a number must be equal or alone."""
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    conv = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in conv.items()}
    made = {}
    for c, x in conv.items():
        h = zlib.crc32(str(c).encode()) % 4
        root = c - (c % 20 if c >= 0 else -(-c % 20))
        made[c] = conv.get(root, [])[:h] + x[h:]
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    saved, leaves, children = {}, {}, defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        saved[p] = saved.get(p, 0) + (len(members[p]) - 1) * words
        leaves[p] = leaves.get(p, 0) or 1
        if p:
            saved[p[:-1]] = saved.get(p[:-1], 0) + saved[p]
            leaves[p[:-1]] = leaves.get(p[:-1], 0) + leaves[p]
    out = []
    for p, m in members.items():
        stop = ",".join(str(c) for c in m if len(made[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(stop.encode()).hexdigest()))
    return sorted(out, key=str)


def _collected(df):
    return sorted(map(tuple, prefix_trie.prefix_trie(df).collect()), key=str)


def _rows():
    rng = random.Random(11)
    first = ("user", "the first turn that a third of all share")
    rows = []
    for c in [*range(0, 130), -1, -3, -20, -25, 4096, 8199, 10**12]:
        x = [first] if rng.random() < 0.4 else []
        x += [(rng.choice(["user", "assistant", None]), rng.choice(["yes", "no  and\tno", "", None, "a b c"])) for _ in range(rng.randrange(7))]
        for k, (r, t) in enumerate(x):
            rows.append((c, None if k == 0 and c % 5 == 0 else k * 3, r, t))
    rows += [(300, 1, "user", "same"), (300, 1, "user", "same"), (None, 1, "user", "nobody"), (301, 0, "u", "only")]
    rows += [(c, k, "user", f"turn {k}") for c in (400, 402) for k in range(60 + c % 7)]
    rows += [(500, 0, "user", "word " * 20_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("stretch", [4096, 7])
def test_trie_equals_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", stretch)
    rows = _rows()
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id long, turn int, role string, text string, depth int, k1 string").repartition(4)
    assert _collected(df) == brute(rows)


def test_trie_of_few_rows(spark):
    df = spark.createDataFrame([(1, 0, "u", "a")], "conv_id long, turn int, role string, text string")
    assert _collected(df.filter("false")) == []
    assert _collected(df) == brute([(1, 0, "u", "a")])
    turnless = [(c, 0, "u", "a") for c in range(1, 20)]
    df = spark.createDataFrame(turnless, df.schema)
    assert _collected(df) == brute(turnless)
