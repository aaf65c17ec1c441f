"""Raw readings: fixed-schema scan with ordered fallback (S1, S2), load profile
(S3, A15) and staging to year-partitioned Parquet (S7)."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panelcast.functions.dates import parse_date

# The 13 columns of the station-readings file, all text in the raw layer. Seven are
# used (location, so2, no2, rspm, spm, pm2_5, date); the rest pass through untouched.
RAW_COLUMNS = (
    "stn_code", "sampling_date", "state", "location", "agency", "type",
    "so2", "no2", "rspm", "spm", "location_monitoring_station", "pm2_5", "date",
)
RAW_SCHEMA = StructType([StructField(c, StringType(), True) for c in RAW_COLUMNS])


def file_headers(spark: SparkSession, path: str, sep: str = ",") -> dict[tuple[str, ...], list[str]]:
    """Header of each file under ``path`` (any Hadoop file system, compressed or not) -> its files.

    Only the listing and the first line of each file are read, by a few threads of the driver: one name a
    file, as the scan itself lists them. Empty files have no header and are left out.
    """
    files = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def first_line(file: str) -> str | None:
        where = jvm.org.apache.hadoop.fs.Path(file)
        stream = where.getFileSystem(conf).open(where)
        try:
            codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
            text = codec.createInputStream(stream) if codec is not None else stream
            return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(text, "UTF-8")).readLine()
        finally:
            stream.close()

    with ThreadPoolExecutor(max_workers=16) as pool:
        lines = list(pool.map(first_line, files))
    layouts: dict[tuple[str, ...], list[str]] = {}
    for file, line in zip(files, lines):
        if line:
            names = tuple(n.strip() for n in next(csv.reader([line.lstrip("\ufeff")], delimiter=sep)))
            layouts.setdefault(names, []).append(file)
    return layouts


def _by_header(spark: SparkSession, path: str, schema: StructType, missing: str) -> DataFrame:
    """One scan per header layout, its columns taken by name, all of them united."""
    layouts = file_headers(spark, path)
    if not layouts:
        raise ValueError(f"{path}: no file with a header")
    found = None
    for names, files in sorted(layouts.items()):
        lacking = [f.name for f in schema.fields if f.name not in names]
        if lacking and missing == "error":
            raise ValueError(f"{files[0]}: no column {', '.join(lacking)} in the header")
        # by position within a layout; names that repeat or are not wanted stay unread
        raw = StructType([StructField(f"_c{i}", StringType(), True) for i in range(len(names))])
        part = spark.read.schema(raw).option("header", True).option("enforceSchema", True).csv(path if len(layouts) == 1 else files)
        place = {n: f"_c{i}" for i, n in reversed(list(enumerate(names)))}
        part = part.select(*[(F.col(place[f.name]) if f.name in place else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
        found = part if found is None else found.unionByName(part)
    return found


def read_readings(spark: SparkSession, paths: str | Sequence[str], fmt: str = "csv",
                  schema: StructType | None = RAW_SCHEMA, header: bool = True,
                  infer_schema: bool = False, missing: str = "error", verify: str = "first") -> DataFrame:
    """Read the first candidate location that can be read (any Hadoop FS scheme).

    Whatever keeps a location from being resolved or read — no such path, host or file system, a
    damaged file — moves on to the next; the error names every cause. ``verify`` says how far that is
    looked at: ``first`` reads the first row, ``count`` counts all rows (one pass over the data, which
    finds any damaged file), ``none`` reads nothing. With a fixed schema a CSV file's columns are taken
    by the names in its own header, in any order and differing from file to file of a folder; further columns
    are left out, and a missing one is an error (not a further location), or null with ``missing="null"``. Set
    ``schema=None, infer_schema=True`` for inferred types (an eager pass, and types that
    depend on file content).
    """
    if missing not in ("error", "null") or verify not in ("first", "count", "none"):
        raise ValueError("missing is error or null, verify is first, count or none")
    candidates = [paths] if isinstance(paths, str) else [p for p in paths if p]
    errors = []
    for path in candidates:
        try:
            if fmt == "csv" and header and schema is not None:
                found = _by_header(spark, path, schema, missing)
            else:
                reader = spark.read.format(fmt)
                if fmt == "csv":
                    reader = reader.option("header", header)
                    if schema is None:
                        reader = reader.option("inferSchema", infer_schema)
                found = (reader if schema is None else reader.schema(schema)).load(path)
            if verify == "first":
                found.isEmpty()
            elif verify == "count":
                # every column, as a count alone would not parse the rows
                found.agg(*[F.count(F.col(f"`{c}`")) for c in found.columns]).collect()
        except (PySparkException, Py4JJavaError) as exc:
            errors.append(f"{path}: {type(exc).__name__}: {str(exc).strip().splitlines()[0][:200]}")
            continue
        return found
    raise FileNotFoundError("no readable data location: " + "; ".join(errors or ["none given"]))


def load_profile(df: DataFrame) -> DataFrame:
    """One-row shape summary (rows, columns) in a single aggregate job."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def observe_profile(df: DataFrame, name: str = "load_profile"):
    """Row count gathered while the DataFrame is consumed by its next action
    (no extra pass). Returns ``(df, observation)``; read ``observation.get``
    after the action: ``{"rows": n}``."""
    from pyspark.sql import Observation
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def stage_dataset(df: DataFrame, dst: str, date_col: str = "date", partition_col: str = "year",
                  rows_per_file: int = 5_000_000) -> DataFrame:
    """Write raw readings as Parquet partitioned by year, then read them back.

    Later year filters (the chronological split) prune whole directories.
    Rows whose date does not parse land in the ``__HIVE_DEFAULT_PARTITION__``.
    Rows are dealt by year and a salt sized from the year's count, so a year has
    about one file per ``rows_per_file`` rows however many tasks read the input and
    no year meets in one task. The counts of what was read and what was written are
    compared year by year; a difference raises.
    """
    staged = df.withColumn(partition_col, F.year(parse_date(date_col)))
    counts = {r[partition_col]: r["n"] for r in staged.groupBy(partition_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    files = F.lit(1)
    for year, n in counts.items():  # one entry per year
        files = F.when(F.col(partition_col).eqNullSafe(F.lit(year)), F.lit(-(-n // rows_per_file))).otherwise(files)
    salt = F.pmod(F.xxhash64(*df.columns), files)
    tasks = max(1, sum(-(-n // rows_per_file) for n in counts.values()))
    (staged.withColumn("_salt", salt).repartition(tasks, partition_col, "_salt").drop("_salt")
     .write.mode("overwrite").partitionBy(partition_col).parquet(dst))
    back = df.sparkSession.read.parquet(dst)
    if counts:
        found = {r[partition_col]: r["n"] for r in back.groupBy(partition_col).agg(F.count(F.lit(1)).alias("n")).collect()}
        if found != counts:
            raise RuntimeError(f"{dst}: rows staged by {partition_col} {found}, rows read {counts}")
    return back
