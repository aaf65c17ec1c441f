"""Vectors, shards, archives, registration and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import kd_sharding, rotated_codes, warc_merkle

from .conftest import SF


def _brute(ids, vectors, q, k):
    d = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((1500, 24)).astype(np.float32)
    v[500:1000] = v[3]  # a third are one vector
    v[1000:1100] = v[:100] + 1e-3
    ids = np.arange(1500)
    rows = [(int(i), x.tolist()) for i, x in zip(ids, v)]
    odd = [(9000, None), (9100, [0.0] * 24), (9200, [float("nan")] * 24), (9300, [None] + [1.0] * 23), (None, [1.0] * 24), (9400, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd + rows[:5], "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = rotated_codes.nearest(df, F.col("vec_id") % 100 == 0).collect()
    assert {r["query_id"] for r in got} == set(range(0, 1500, 100))
    for q in range(0, 1500, 100):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        want = _brute(ids, v.astype(float), q, 10)
        assert [r["vec_id"] for r in mine] == [w[0] for w in want] and [r["rank"] for r in mine] == list(range(1, 11))
        assert [r["score"] for r in mine] == pytest.approx([w[1] for w in want], abs=1e-12)
    few = df.filter("vec_id in (0, 1, 2)")
    assert rotated_codes.nearest(few, F.col("vec_id") == 0).count() == 2
    assert rotated_codes.nearest(df.filter("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_query_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.random(8).tolist()) for i in range(300)], "vec_id long, embedding array<float>")
    whole = rotated_codes.nearest(df, F.col("vec_id") % 10 == 0).collect()
    monkeypatch.setattr(rotated_codes, "QUERY_BYTES", 8 * 8 * 9)
    assert sorted(rotated_codes.nearest(df, F.col("vec_id") % 10 == 0).collect()) == sorted(whole)


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(0)
    v, c = rng.standard_normal((400, 64)), np.zeros(64)
    codes, length, dot = rotated_codes._encode(v, c, rotated_codes.rotation(64))
    signs = np.unpackbits(codes, axis=1, count=64) * 2.0 - 1
    q = (v / length[:, None]) @ rotated_codes.rotation(64)
    est = (q @ signs.T) / 8 / dot
    error = rotated_codes.EPSILON * np.sqrt((1 - dot**2) / dot**2 / 63)
    assert (np.abs(est - (v @ v.T) / np.outer(length, length)) <= error[None, :]).mean() > 0.99


def test_kd_shards(spark, edge, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hot = docs.union(docs.limit(1).crossJoin(spark.range(2000)).select((F.col("id") + 10**6).alias("doc_id"), "text", "lang", "source", "n_chars"))
    for df, total in ((docs, 200), (hot, 2200)):
        rows = kd_sharding.kd_shards(df).collect()
        text = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
        assert len(rows) == total and {r["law"] for r in rows} == {"bytes"}
        assert all(r["size"] == len(text[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in rows)
        sizes = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows], 24)
        assert sizes.max() - sizes.min() <= 5 * max(r["size"] for r in rows)  # a cut a level, each within a document
        for s in range(24):
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    rows = kd_sharding.kd_shards(edge, shards=3).collect()
    assert len(rows) == 10 and {r["shard"] for r in rows} <= {0, 1, 2}
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (1, 2)} == {(8, 0)}
    assert kd_sharding.kd_shards(empty).count() == 0


def test_even_shards_of_small_documents(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("a").alias("source"))
    sizes = [r["s"] for r in kd_sharding.kd_shards(df).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 24 and max(sizes) <= 1.01 * min(sizes)


def test_merkle_audit_locates_each_fault(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i % 7}", "page " * (i % 50)) for i in range(600)] + [(None, None, None), (3, None, ""), (3, None, "")],
                                  "page_id long, url string, html string")
    records = warc_merkle.archive(pages, rows_per_file=200).cache()
    assert records.count() == 603
    body = records.filter("record_id = 49").first()
    assert bytes(body["record"]).startswith(b"WARC/1.0\r\n") and bytes(body["record"]).endswith(b"\r\n\r\n")
    assert warc_merkle.audit(records, records).count() == 0
    rng = random.Random(0)
    ids = rng.sample(range(10, 600), 12)
    changed, lost = ids[:6], ids[6:]
    replica = (records.filter(~F.coalesce(F.col("record_id").isin(lost), F.lit(False)))
               .withColumn("record", F.when(F.col("record_id").isin(changed), F.concat(F.lit(b"?"), F.substring("record", 2, 10**6))).otherwise(F.col("record"))))
    where = {(r["file"], r["offset"]): r["record_id"] for r in records.filter("record_id >= 10").collect()}
    got = warc_merkle.audit(records, replica).collect()
    assert {where[r["file"], r["offset"]]: r["fault"] for r in got} == {**{i: "changed" for i in changed}, **{i: "missing" for i in lost}}
    back = warc_merkle.audit(replica, records).collect()
    assert sum(r["fault"] == "extra" for r in back) == 6 and len(back) == 12
    none = records.filter("false")
    assert warc_merkle.audit(records, none).count() == 603 and warc_merkle.audit(none, none).count() == 0
    assert warc_merkle.archive(pages.filter("false")).count() == 0


def test_many_equal_pages_spread_over_files(spark):
    rows = [(7, "u", "same")] * 400 + [(None, None, None)] * 60 + [(1000 + k, f"u{k}", f"page {k}") for k in range(540)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    a, b = (warc_merkle.archive(x, rows_per_file=50).orderBy("file", "offset").collect() for x in (pages, pages.repartition(5)))
    assert a == b and len(a) == 1000
    assert sum(r["record_id"] == 7 for r in a) == 400 and sum(r["record_id"] is None for r in a) == 60
    per_file = Counter(r["file"] for r in a if r["record_id"] == 7)
    assert len(per_file) == 20 and set(per_file.values()) == {20}
    for x, y in zip(a, a[1:]):
        assert y["offset"] == (x["offset"] + x["length"] if x["file"] == y["file"] else 0)


def test_audit_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = warc_merkle.audit_pages(pages, every=20)
    records = warc_merkle.archive(pages)
    h = F.pmod(F.xxhash64(F.lit(9), "record_id", "offset"), F.lit(20))
    want = {r["record_id"]: "missing" if r["h"] == 2 else "changed" for r in records.withColumn("h", h).filter("h < 3").collect()}
    assert {r["record_id"]: r["fault"] for r in found.collect()} == want and want


def test_queries_are_registered():
    import __spark_entry__ as e
    names = e.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline as c
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    bad = spark.createDataFrame([(9001, benchmark, "en", "src1", 1), (9002, "1234 5678", "en", "src1", 1), (9003, None, None, None, None)], docs.schema)
    at = docs.union(bad).union(docs.limit(10).withColumn("doc_id", F.col("doc_id") + 100_000))
    names = [n for n, _ in c.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    seen = {}
    from panelcast.llm.scratch import stored
    for name, stage in c.STAGES:
        at = stored(stage(spark, at, SF), f"test-{name}")
        seen[name] = at
        assert name == "sharding" or at.columns == docs.columns
    ids = lambda n: {r["doc_id"] for r in seen[n].select("doc_id").collect()}
    assert not ids("language_id") & {9002, 9003} and seen["language_id"].count() == 91
    assert not any(i > 100_000 for i in ids("near_dedup")) and 9001 in ids("near_dedup")
    assert 9001 not in ids("decontamination")
    assert seen["sharding"].count() == seen["mixing"].count()


def test_near_dedup_keeps_different_texts_of_one_id(spark):
    import corpus_pipeline as c
    text = lambda k: " ".join(f"w{k}x{n}" for n in range(40))
    rows = [(1, text(1), "en", "b", 1), (1, text(2), "en", "a", 1), (2, text(2), "en", "a", 1), (2, text(3) + " more", "en", "a", 1),
            (3, text(3), "en", "b", 1), (3, text(3), "en", "a", 1), (4, text(4), "de", "z", 1), (4, text(4), "de", "y", 1), (4, None, None, None, None),
            (5, text(5), "en", None, 1), (5, text(5) + " more", "en", "a", 1), (None, text(1), "en", "a", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    want = {(1, text(1), "b"), (1, text(2), "a"), (2, text(3) + " more", "a"), (4, text(4), "y"), (4, None, None), (None, text(1), "a")}
    for order in (rows, rows[::-1]):
        got = c.near_dedup(spark, spark.createDataFrame(order, schema).repartition(3), SF)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out = [(r["doc_id"], r["text"], r["source"]) for r in got.collect()]
        five = [r for r in out if r[0] == 5]
        assert len(five) == 1 and set(out) - set(five) == want and len(out) == 7
    plain = spark.createDataFrame([r for r in rows if r[0] in (3, None)], schema)
    assert {(r["doc_id"], r["source"]) for r in c.near_dedup(spark, plain, SF).collect()} == {(3, "a"), (None, "a")}
