"""Corpus pipeline over ``documents``: each stage takes (spark, docs, sf_dir) and
returns a DataFrame, written as Parquet and read again as the next stage's input.

Every stage works on all rows its predecessor kept and its decisions take effect:

- language ID drops documents without a letter and those no language explains better
  than all others together;
- near-dedup keeps one document of each near-duplicate component;
- decontamination drops documents that hold a benchmark item;
- mixing repeats a source's documents for complete epochs, then samples, to its target;
- sharding adds the shard and slot of every row.

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.queries import ship, table
from panelcast.llm.scratch import stored

#: A document stays if its language's posterior is at least this.
LEAST_POSTERIOR = 0.5
SHARDS = 24


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; the model is fitted on their labelled ones.
    Without any labelled document there is no language to recognise and documents with a letter stay."""
    import public_tokenizers
    from panelcast.llm.language_id import VOCABULARY, fit, predict
    ship(spark)
    model = fit(docs, public_tokenizers.path(VOCABULARY), F.lit(True))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    named = predict(docs.withColumns({f"_kept_{c}": F.col(c) for c in ("lang_pred", "score") if c in docs.columns}), model)
    kept = named.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_POSTERIOR))
    return kept.select(*[F.col(f"_kept_{c}").alias(c) if c in ("lang_pred", "score") else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five-word shingles, similarity 0.8);
    rows without an id are linked with nothing and stay.

    A document is an id with a text: rows that agree in both are one (the least by their other
    columns stays), and different texts of one id are linked by similarity only. The
    least (id, MD5 of the text) of a component stays."""
    from panelcast.llm.near_dup import near_duplicates
    ship(spark)
    digest = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    named, others = docs.filter("doc_id is not null"), [c for c in docs.columns if c not in ("doc_id", "text")]
    least = F.min(F.struct(*others, "text")).alias("least")  # the text last: it is equal within a document
    row = ["least." + c if c != "doc_id" else c for c in docs.columns]
    several = named.groupBy("doc_id").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).filter("a <> b")
    if several.isEmpty():
        kept = near_duplicates(docs, width=5).filter("kept and doc_id is not null").select("doc_id").distinct()
        one = named.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(least).select(*row)
    else:  # documents get numbers of their own
        numbered = stored(named.groupBy("doc_id", digest.alias("digest")).agg(least)
                          .select(F.monotonically_increasing_id().alias("number"), "doc_id", "digest", "least"), "numbered")
        found = near_duplicates(numbered.select("number", "least.text"), doc_id="number", width=5)
        kept = (found.select(F.col("doc_id").alias("number"), "component_id").join(numbered.select("number", "doc_id", "digest"), "number")
                .groupBy("component_id").agg(F.min(F.struct("doc_id", "digest", "number")).alias("first")).select("first.number"))
        one = numbered.join(kept, "number", "left_semi").select(*row)
    return one.select(*docs.columns).union(docs.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    from panelcast.llm.decontaminate import decontaminate
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as rows: a document once for every epoch that takes it."""
    from panelcast.llm.mixing import mixed_rows, quality_weights
    return mixed_rows(docs, quality=quality_weights(table(spark, sf_dir, "labels")))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot of every row of the mix."""
    from panelcast.llm.kd_sharding import kd_shards
    ship(spark)
    return kd_shards(docs, shards=SHARDS)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
