"""Merkle fixity audit of WARC records and their replicas.

Records are laid out in archive files in order; the leaf of a record is the
SHA-256 of its bytes, and every inner node is the SHA-256 of the ordered
(position, hash) pairs of its children, a node standing for an aligned range of
offsets: RANGE_BITS wide at level 1, FAN_BITS wider a level above. Two replicas are compared from
the roots down; only children of mismatching nodes are looked at, so a clean
file costs one row and a corrupt record one path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.scratch import stored

RANGE_BITS, FAN_BITS = 18, 4
ROWS_PER_FILE = 1_000


#: Date of records whose pages have none.
DATE = "1970-01-01T00:00:00Z"


def warc_record(url: Column, payload: Column, date: str = DATE) -> Column:
    """Bytes of a WARC resource record; null url or payload as empty. The record id is a name made of a hash
    of both, so that equal pages give equal records."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(payload, F.lit("")).cast("binary")
    name = F.regexp_replace(F.md5(F.concat(url.cast("binary"), F.lit(b"\0"), body)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), name, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
                    F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
            rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """One row per page: file, offset, length, record_id, record.

    Pages are dealt to files by a hash of the whole page, so no host or id fills one file;
    rows equal in all three columns go to one, but if they are more than ``rows_per_file``,
    they are numbered and dealt in turn to all files. ``rows_per_file`` is the mean,
    not a bound. Within a file rows follow in order of
    id, url and content. Nulls are empty texts (a null id stays null, first); an empty
    table gives no rows; other columns are not read.
    """
    rows = pages.select(F.col(page_id).alias("record_id"), F.col(url).cast("string").alias("_url"), F.col(html).cast("string").alias("_html"))
    files = F.greatest(F.lit(1), F.ceil(F.lit(pages.count()) / rows_per_file)).cast("int")
    record = warc_record(F.col("_url"), F.col("_html"))
    rows = rows.withColumn("_h", F.xxhash64("record_id", "_url", "_html"))
    # at most one hash in rows_per_file rows
    often = F.broadcast(rows.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows_per_file).select("_h"))
    once = rows.join(often, "_h", "left_anti").withColumn("_copy", F.lit(0).cast("long"))
    # counted, then made again in shares of rows_per_file, so that numbers do not depend on the order of the input
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.join(often, "_h", "left_semi").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    shares = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(rows_per_file).cast("long"))))
    copies = (shares.repartition(tasks, "_h", "_from")
              .withColumn("_copy", F.explode(F.sequence("_from", F.least(F.col("_from") + rows_per_file, "n") - 1))))
    rows = once.unionByName(copies.select(*once.columns))
    rows = rows.select("record_id", F.pmod(F.pmod("_h", files) + F.col("_copy"), files).cast("int").alias("file"),
                       "_url", record.alias("record")).withColumn("length", F.octet_length("record").cast("long"))
    order = Window.partitionBy("file").orderBy("record_id", "_url", "record")
    upto = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("offset", (upto - F.col("length")).cast("long")).select("file", "offset", "length", "record_id", "record")


def leaves(records: DataFrame) -> DataFrame:
    """Level 0: file, level, at (the offset), hash of the record's bytes."""
    return records.select("file", F.lit(0).alias("level"), F.col("offset").alias("at"),
                          F.sha2(F.coalesce(F.col("record"), F.lit(b"")), 256).alias("hash"), "length")


def tree(records: DataFrame, levels: int) -> DataFrame:
    """All nodes: file, level, at, hash, length. ``at`` is the offset of a leaf and the
    number of the offset range above; the only node of level ``levels`` is the file's root.

    A node's children are at most 2**FAN_BITS ranges; a level-1 range holds the records that
    start in 2**RANGE_BITS bytes. Repeated rows are repeated leaves and count.
    """
    nodes = leaves(records)
    out, below = nodes, nodes
    for level in range(1, levels + 1):
        up = F.shiftright(F.col("at"), RANGE_BITS if level == 1 else FAN_BITS)
        if level == levels:
            up = F.lit(0).cast("long")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "hash", "length"))),
                                        lambda c: F.concat_ws(":", c["at"].cast("string"), c["hash"], c["length"].cast("string"))), ",")
        below = below.groupBy("file", up.alias("at")).agg(F.sha2(text, 256).alias("hash"), F.sum("length").alias("length"))
        below = below.select("file", F.lit(level).alias("level"), "at", "hash", "length")
        out = out.unionByName(below)
    return out


def levels_for(most_bytes: int) -> int:
    """Levels above the leaves until one range covers ``most_bytes`` bytes."""
    level = 1
    while (most_bytes >> (RANGE_BITS + FAN_BITS * (level - 1))) >= 2**FAN_BITS:
        level += 1
    return level + 1


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records (file, offset, length, fault) that differ between two replicas, each a
    table file, offset, record. ``fault``: changed, missing (only in the primary) or extra (only in
    the replica); ``length`` is the primary's, of extra records the replica's.

    Roots are compared first (a full join, a row per file); each level below joins
    only the children of mismatching nodes. Null records hash as empty, empty tables make every record of
    the other one missing or extra, equal replicas give no rows.
    """
    most = [0]
    both = []
    for side in (primary, replica):
        side = side.select("file", "offset", "record", F.octet_length(F.coalesce("record", F.lit(b""))).cast("long").alias("length"))
        both.append(side)
        most.append(side.agg(F.max(F.col("offset") + F.col("length"))).first()[0] or 0)
    levels = levels_for(max(most))
    a, b = (stored(tree(x, levels), "merkle") for x in both)
    bad = None
    for level in range(levels, -1, -1):
        x, y = (n.filter(F.col("level") == level).select("file", "at", "hash", "length") for n in (a, b))
        if bad is not None:
            up = F.shiftright(F.col("at"), RANGE_BITS if level == 0 else FAN_BITS)
            up = F.lit(0).cast("long") if level + 1 == levels else up
            parent = bad.select("file", F.col("at").alias("_up"))
            x, y = (n.withColumn("_up", up).join(parent, ["file", "_up"], "left_semi").drop("_up") for n in (x, y))
        # equal rows pair off by their rank among the rows of one position
        rank = F.row_number().over(Window.partitionBy("file", "at").orderBy("hash"))
        x, y = (n.withColumn("k", rank) for n in (x, y))
        y = y.withColumnsRenamed({"hash": "hash_b", "length": "length_b"})
        bad = x.join(y, ["file", "at", "k"], "full").filter(~F.col("hash").eqNullSafe(F.col("hash_b")) | ~F.col("length").eqNullSafe(F.col("length_b")))
        if level:
            bad = stored(bad.select("file", "at").distinct(), "mismatch")
    fault = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("changed")
    return bad.select("file", F.col("at").alias("offset"), F.coalesce("length", "length_b").alias("length"), fault.alias("fault"))


def damaged_copy(records: DataFrame, every: int = 500) -> DataFrame:
    """A replica with faults that follow from the record ids: of each ``every`` hash
    values one record loses its last byte, one has its first byte replaced and one is lost. Where no record
    has such a value, the three records of the least hashes stand in, so that few records are damaged, too."""
    whole = F.xxhash64(F.lit(9), "record_id", "offset")
    h = F.pmod(whole, F.lit(every))
    if records.filter(h < 3).isEmpty():
        least = [r[0] for r in records.select(whole.alias("h")).distinct().orderBy("h").limit(3).collect()]
        for k, value in enumerate(least):
            h = F.when(whole == value, k).otherwise(h)
    rec = F.col("record")
    cut = F.substring(rec, F.lit(1), F.octet_length(rec) - 1)
    swapped = F.concat(F.lit(b"#"), F.substring(rec, F.lit(2), F.octet_length(rec)))
    return records.filter(h != 2).withColumn("record", F.when(h == 0, cut).when(h == 1, swapped).otherwise(rec))


def audit_pages(pages: DataFrame, every: int = 500) -> DataFrame:
    """Archive of all pages against a replica damaged by ``damaged_copy``: the faults found. Both
    replicas are tables of records in the shared folder, their bytes compressed."""
    primary = stored(archive(pages), "warc-primary", "zstd")
    replica = stored(damaged_copy(primary, every), "warc-replica", "zstd")
    found = audit(primary, replica)
    ids = primary.select("file", "offset", "record_id")
    return found.join(ids, ["file", "offset"], "left").select("file", "offset", "length", "record_id", "fault")
