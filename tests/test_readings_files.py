"""Folders of CSV files with differing headers, and locations that can't be read to the end."""

import gzip
import os
import tempfile

import pytest

from panelcast.sources.readings import RAW_COLUMNS, file_headers, read_readings


def _write(path, names, rows, opener=open):
    with opener(path, "wt", encoding="utf-8") as fh:
        fh.write(",".join(names) + "\n")
        for r in rows:
            fh.write(",".join(r.get(n, "") for n in names) + "\n")


def _row(k):
    return {c: f"{c}-{k}" for c in RAW_COLUMNS}


def test_each_file_by_its_own_header(spark):
    d = tempfile.mkdtemp()
    _write(f"{d}/a.csv", RAW_COLUMNS, [_row(1), _row(2)])
    _write(f"{d}/b.csv", [*RAW_COLUMNS[::-1], "extra"], [_row(3)])
    _write(f"{d}/c.csv.gz", ["extra", *sorted(RAW_COLUMNS)], [_row(4)], gzip.open)
    _write(f"{d}/d.csv", [f'"{c}"' for c in RAW_COLUMNS], [])
    open(f"{d}/empty.csv", "w").close()
    open(f"{d}/_SUCCESS", "w").close()
    assert {len(f) for f in file_headers(spark, d).values()} == {1, 2} and len(file_headers(spark, d)) == 3
    got = sorted(tuple(r) for r in read_readings(spark, d).collect())
    assert got == [tuple(f"{c}-{k}" for c in RAW_COLUMNS) for k in (1, 2, 3, 4)]
    assert read_readings(spark, d).columns == list(RAW_COLUMNS)


def test_missing_columns(spark):
    d = tempfile.mkdtemp()
    _write(f"{d}/a.csv", RAW_COLUMNS, [_row(1)])
    _write(f"{d}/b.csv", RAW_COLUMNS[:-2], [_row(2)])
    with pytest.raises(ValueError, match="pm2_5, date"):
        read_readings(spark, d)
    got = sorted((r["stn_code"], r["date"]) for r in read_readings(spark, d, missing="null").collect())
    assert got == [("stn_code-1", "date-1"), ("stn_code-2", None)]
    with pytest.raises(ValueError):
        read_readings(spark, d, missing="maybe")


def test_fallback_past_damaged_files(spark):
    d, good = tempfile.mkdtemp(), tempfile.mkdtemp()
    _write(f"{good}/a.csv", RAW_COLUMNS, [_row(1)])
    _write(f"{d}/whole.csv.gz", RAW_COLUMNS, [{c: os.urandom(40).hex() for c in RAW_COLUMNS} for _ in range(2000)], gzip.open)
    with open(f"{d}/whole.csv.gz", "rb") as fh:
        data = fh.read()
    cut = tempfile.mkdtemp()
    with open(f"{cut}/cut.csv.gz", "wb") as fh:
        fh.write(data[:len(data) // 2])
    # the first rows of the cut file can be read, its end can't
    assert read_readings(spark, [f"{cut}/cut.csv.gz", good], verify="count").count() == 1
    with open(f"{cut}/junk.parquet", "wb") as fh:
        fh.write(b"no parquet at all")
    spark.createDataFrame([("x",)], "a string").write.parquet(f"{good}-parquet")
    assert read_readings(spark, [f"{cut}/junk.parquet", f"{good}-parquet"], fmt="parquet", schema=None).count() == 1
    with pytest.raises(FileNotFoundError, match="cut.csv.gz"):
        read_readings(spark, [f"{d}/none.csv", f"{cut}/cut.csv.gz"], verify="count")
