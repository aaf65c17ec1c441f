"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.session import ship_package

#: Rows of an Arrow batch: documents are long, and each batch is held by the JVM and by Python.
ARROW_ROWS = 500


def ship(spark: SparkSession) -> None:
    """Give the package to the executors' Python (as ``--py-files`` would), once an application,
    and make Arrow batches small where the session has Spark's default."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    ship_package(spark)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def op5_bm25_decontamination(spark, d):
    from panelcast.llm.decontaminate import contaminated
    return contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op6_string_kernel_toxicity(spark, d):
    from panelcast.llm.toxicity import fit, score
    from panelcast.llm.words import crc_mod
    docs = table(spark, d, "documents")
    held_out = crc_mod("doc_id", 5) == 0
    model = fit(docs, table(spark, d, "labels"), ~held_out)
    return score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op7_minhash_near_dedup(spark, d):
    from panelcast.llm.near_dup import near_duplicates
    return near_duplicates(table(spark, d, "documents"), width=2)


def op1_language_id(spark, d):
    import public_tokenizers
    from panelcast.llm.language_id import VOCABULARY, fit, predict
    from panelcast.llm.words import crc_mod
    docs = table(spark, d, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = fit(docs, public_tokenizers.path(VOCABULARY), ~held_out)
    texts = docs.select("doc_id", held_out.alias("held_out"), "text")
    return predict(texts, model).select("doc_id", "held_out", "lang_pred", "score")


def op2_repair_tokens(spark, d):
    import public_tokenizers
    from panelcast.llm.repair_tokens import VOCABULARY, token_file
    return token_file(table(spark, d, "documents"), public_tokenizers.path(VOCABULARY))


def op3_rotated_one_bit_codes(spark, d):
    from panelcast.llm.rotated_codes import nearest
    return nearest(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_kd_tree_sharding(spark, d):
    from panelcast.llm.kd_sharding import kd_shards
    return kd_shards(table(spark, d, "documents"))


def op8_separator_scan(spark, d):
    import public_tokenizers
    from panelcast.llm.separator_scan import VOCABULARY, token_counts
    return token_counts(table(spark, d, "documents"), public_tokenizers.path(VOCABULARY))


def op9_warc_merkle_audit(spark, d):
    from panelcast.llm.warc_merkle import audit_pages
    return audit_pages(table(spark, d, "pages"))


def op10_mixing(spark, d):
    from panelcast.llm.mixing import mix, quality_weights
    docs = table(spark, d, "documents")
    return mix(docs, quality=quality_weights(table(spark, d, "labels"))).drop("tie")


def op11_conversation_prefix_trie(spark, d):
    from panelcast.llm.prefix_trie import prefix_trie
    return prefix_trie(table(spark, d, "conversations"))


def op12_line_dedup(spark, d):
    from panelcast.llm.line_dedup import drop_repeated_lines
    docs = drop_repeated_lines(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_cross_tokenizer_alignment(spark, d):
    import public_tokenizers
    from panelcast.llm.cross_tokens import A_VOCABULARY, B_VOCABULARY, cross_tokenized
    made = cross_tokenized(table(spark, d, "documents"), *map(public_tokenizers.path, (A_VOCABULARY, B_VOCABULARY)))
    return made.withColumnRenamed("groups", "groups_sha256")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_repair_tokens": op2_repair_tokens,
    "op3_rotated_one_bit_codes": op3_rotated_one_bit_codes,
    "op4_kd_tree_sharding": op4_kd_tree_sharding,
    "op5_bm25_decontamination": op5_bm25_decontamination,
    "op6_string_kernel_toxicity": op6_string_kernel_toxicity,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_separator_scan": op8_separator_scan,
    "op9_warc_merkle_audit": op9_warc_merkle_audit,
    "op10_mixing": op10_mixing,
    "op11_conversation_prefix_trie": op11_conversation_prefix_trie,
    "op12_line_dedup": op12_line_dedup,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# crc32 of the decimal digits of an id, byte by byte and bit by bit
_CRC = ("xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), "
        "lambda c: CAST(ascii(c) AS UBIGINT))), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], "
        "lambda x, k: xor(x >> 1, (x & 1) * 3988292384))))")

ORACLE: dict[str, str] = {
    "op11_conversation_prefix_trie": f"""
        WITH placed AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (SELECT DISTINCT conv_id, CAST({_CRC} % 4 AS BIGINT) AS h FROM placed),
        pieces AS (
            SELECT i.conv_id, 0 AS part, pos, role, text FROM ids i JOIN placed p ON p.conv_id = i.conv_id - i.conv_id % 20 AND pos < h
            UNION ALL
            SELECT conv_id, 1, pos, role, text FROM ids JOIN placed USING (conv_id) WHERE pos >= h),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM pieces),
        members AS (
            SELECT conv_id, depth, text, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM ordered
            UNION ALL
            SELECT conv_id, 0, '', '' FROM ids),
        nodes AS (
            SELECT path, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                   (count(*) - 1) * len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) AS saved,
                   left(path, greatest(length(path) - 64, 0)) AS over
            FROM members GROUP BY path),
        children AS (SELECT over AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY over),
        totals AS (
            SELECT m.path, sum(v.saved) AS saved_tokens, count(*) FILTER (WHERE c.path IS NULL) AS n_leaves
            FROM nodes v LEFT JOIN children c ON c.path = v.path JOIN members m ON m.conv_id = v.conv_id AND m.depth <= v.depth GROUP BY m.path),
        stops AS (
            SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
            FROM (SELECT conv_id, max_by(path, depth) AS path FROM members GROUP BY conv_id) GROUP BY path)
        SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, CASE WHEN n.depth > 0 THEN p.conv_id END AS parent_conv_id, n.n_convs,
               coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM nodes n JOIN nodes p ON p.path = n.over JOIN totals t ON t.path = n.path
        LEFT JOIN children c ON c.path = n.path LEFT JOIN stops s ON s.path = n.path""",
    "op12_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
            FROM documents),
        keyed AS (
            SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines),
        repeated AS (
            SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
               CAST(count(*) FILTER (WHERE doc_id < last) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE last IS NULL OR doc_id >= last), '')) AS kept_sha256
        FROM keyed LEFT JOIN repeated USING (key) GROUP BY doc_id""",
}
