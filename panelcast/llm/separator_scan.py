"""Token counts from flat, unindexed token files.

A flat file is nothing but little-endian 16-bit ids, an end-of-document id after
each document. Blocks of a file are searched for that id with numpy, every block on
its own; a block knows where its separators are but not where its first document
began. A prefix scan over the blocks' summaries (ids, separators, position after the last
separator) gives each block its base and the start of the document that is open at its
first id, which stitches documents that span any number of blocks.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.words import as_strings, chunks
from panelcast.session import scratch_path

VOCABULARY = "piece_bpe_32k.model"
#: </s> of that vocabulary; ordinary text never gives it.
END_ID = 2
BLOCK_BYTES = 1 << 20
#: Documents a file at most (files are read whole by Spark's binary reader, so they stay far below 2 GB).
FILE_ROWS = 20_000

_MODELS: dict = {}


def _model(path: str):
    if path not in _MODELS:
        import sentencepiece
        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def write_flat(docs: DataFrame, path: str, vocabulary: str, text: str = "text") -> None:
    """Encode the texts and write flat files of ids under ``path``. Null and empty texts
    are documents of no ids. Spark's text writer puts out the raw bytes of a row and
    the two bytes of END_ID as its line end, and commits files task by task."""

    def encode(batches):
        model = _model(vocabulary)
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                ids = model.encode(as_strings(part.column(0)).to_pylist(), num_threads=1)
                yield pa.RecordBatch.from_arrays([pa.array([np.array(x, "<u2").tobytes() for x in ids], pa.binary())], names=["ids"])

    made = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(encode, "ids binary")
    (made.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", END_ID.to_bytes(2, "little").decode("ascii"))
     .option("maxRecordsPerFile", FILE_ROWS).text(path))


def read_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, data): the files of a folder in blocks of an even number of bytes."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    n = F.ceil(F.col("length") / block_bytes).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        i.alias("block"), F.substring(F.col("content"), i * block_bytes + 1, F.lit(block_bytes)).alias("data")))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.explode(cut).alias("b")).select("file", "b.block", "b.data")


def scan_blocks(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """(file, block, n_ids, ends): positions of the end id within each block."""

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_buffer()
                ids = np.frombuffer(data, "<u2", data.size // 2)
                ends = np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([len(ids)], pa.int64()),
                                                  pa.array([ends], pa.list_(pa.int64()))], names=["file", "block", "n_ids", "ends"])

    return blocks.select("file", F.col("block").cast("int").alias("block"), "data").mapInArrow(
        search, "file string, block int, n_ids long, ends array<long>")


def stitch(scanned: DataFrame) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed): one row per document of each file.

    ``start`` and ``n_tokens`` count ids, the end id not included. Ids after a file's last
    end id are one document with ``closed`` false. The blocks of a file are ordered in one
    task: a file is at most 2 GB, so at most some thousand rows.
    """
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = (scanned.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
            .withColumn("ordinal", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
            .withColumn("last", F.lead("block").over(order).isNull()))
    after_last = F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1) + 1)
    rows = rows.withColumn("open", F.coalesce(F.max(after_last).over(before), F.lit(0)))
    rest = F.col("base") + F.col("n_ids")
    tail = F.col("last") & (F.coalesce(after_last, F.col("open")) < rest)
    begins = F.concat(F.array("open"), F.transform("ends", lambda e: F.col("base") + e + 1))
    ends = F.transform("ends", lambda e: F.col("base") + e)
    ends = F.when(tail, F.concat(ends, F.array(rest))).otherwise(ends)
    # begin and end of each document are zipped inside the generator, once a block: no array is carried to or made anew for a document
    both = F.arrays_zip(F.slice(begins, 1, F.size(ends)).alias("start"), ends.alias("stop"))
    spans = rows.select("file", "ordinal", F.size("ends").alias("n"), F.posexplode(both).alias("k", "span"))
    start, stop = F.col("span")["start"], F.col("span")["stop"]
    return spans.select("file", (F.col("ordinal") + F.col("k")).cast("long").alias("ordinal"), start.cast("long").alias("start"),
                        (stop - start).cast("long").alias("n_tokens"), (F.col("k") < F.col("n")).alias("closed"))


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write the documents as flat token files in the shared folder and count each document's ids
    from the files alone. Null and empty texts are documents of 0 ids, repeated rows are
    documents each, an empty table gives no rows; other columns are not read."""
    spark = docs.sparkSession
    path = os.path.join(scratch_path(spark, "flat-tokens"), "files")
    write_flat(docs, path, vocabulary, text)
    # the writer's file names without its job id, so that reruns agree
    name = F.regexp_replace("file", "-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "")
    return stitch(scan_blocks(read_blocks(spark, path, block_bytes))).withColumn("file", name)
