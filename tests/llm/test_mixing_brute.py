"""The mix against a plain sampler: exponential keys sorted within each source, whole epochs, then prefix sums."""

import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelcast.llm.mixing import MAX_EPOCHS, WEIGHTS, mix, quality_weights

from .conftest import SF


def _brute(rows, weight):
    """(doc_id, tie) -> (target, taken) for rows (doc_id, text, source, tie, hash of the key)."""
    size = {(d, t): len(re.findall("[^\x20\x09-\x0d]+", text or "")) for d, text, _, t, _ in rows}
    by = defaultdict(list)
    for d, _, s, t, h in rows:
        u = ((h % 2**64 >> 11) + 1) / 2**53
        by[s].append((-math.log(u) / weight.get(d, 1.0), d, t))
    sources = sorted(by, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[d, t] for _, d, t in by[s]) for s in sources}
    share = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(sources)}
    target, fixed = {}, set()
    while True:
        rest = sum(total.values()) - sum(target[s] for s in fixed)
        free = [s for s in sources if s not in fixed]
        target.update({s: rest * share[s] / sum(share[x] for x in free) for s in free})
        over = [s for s in free if target[s] > MAX_EPOCHS * total[s]]
        if not over:
            break
        for s in over:
            target[s] = MAX_EPOCHS * total[s]
            fixed.add(s)
    out = {}
    for s in sources:
        whole = int(target[s] // total[s]) if total[s] else 0
        rest, upto = target[s] - whole * total[s], 0
        for _, d, t in sorted(by[s]):
            n = size[d, t]
            upto += n
            extra = n > 0 and rest > 0 and upto - n / 2 <= rest
            out[d, t] = (target[s], min(whole + extra, int(MAX_EPOCHS)) * n)
    return out


@pytest.mark.parametrize("bucket", [3, 40, 2_000])
def test_mix_equals_a_plain_sampler(spark, bucket):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(10**6, None, None), (10**6 + 1, "", "src1"), (10**6 + 2, "tiny source", "zz"), (10**6 + 3, "word " * 5000, None)], docs.schema)
    docs = docs.unionByName(odd)
    quality = quality_weights(spark.read.parquet(f"{SF}/labels.parquet"))
    tie = F.xxhash64("text")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source", tie.alias("t"), F.xxhash64(F.lit(10), "doc_id", tie).alias("h")).collect()]
    weight = {r["doc_id"]: r["weight"] for r in quality.collect() if r["weight"]}
    want = _brute(rows, weight)
    got = {(r["doc_id"], r["tie"]): (r["target"], r["taken"]) for r in mix(docs.repartition(5), quality=quality, rows_per_bucket=bucket).collect()}
    assert got.keys() == want.keys() and len(got) > 150
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(got[k][0] == pytest.approx(want[k][0]) for k in got)
    assert len({v[1] for v in got.values()}) > 10
