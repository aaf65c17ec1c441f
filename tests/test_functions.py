"""Scalar building blocks: tokens, dates, breakpoint sub-indices (FIXTURES §5)."""

import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelcast.functions.breakpoints import BREAKPOINTS, PM25_BREAKPOINTS, aqi_expr, sub_index
from panelcast.functions.dates import parse_date
from panelcast.functions.tokens import clean_double

BP_EDGES = [None, -1.0, 0.0, 30.0, 30.5, 31.0, 250.0, 250.5, 500.0, 500.1, float("nan")]
COMPAT = [None, None, 0.0, 50.0, None, 51.0, 400.0, 401.198, 500.0, 500.0, 500.0]


def _pm25(spark, **kw):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(BP_EDGES)], "i int, c double")
    rows = df.select("i", sub_index("c", PM25_BREAKPOINTS, **kw).alias("s")).orderBy("i").collect()
    return [r["s"] for r in rows]


@pytest.mark.parametrize("bind", [True, False])
def test_breakpoint_edges_compat(spark, bind):
    got = _pm25(spark, compat=True, bind=bind)
    for g, e in zip(got, COMPAT):
        assert (g is None and e is None) or g == pytest.approx(e, abs=1e-9)


def test_breakpoint_nan_default_is_null(spark):
    got = _pm25(spark)
    assert got[-1] is None
    for g, e in zip(got[:-1], COMPAT[:-1]):
        assert (g is None and e is None) or g == pytest.approx(e, abs=1e-9)


def test_gap_policy_round(spark):
    df = spark.createDataFrame([(30.5,), (30.4,)], "c double")
    got = [r[0] for r in df.select(sub_index("c", PM25_BREAKPOINTS, gap_policy="round")).collect()]
    assert got == pytest.approx([51.0, 50.0])


def test_aqi_skips_nulls_and_all_null_is_null(spark):
    df = spark.createDataFrame([(None, None, None, None), (10.0, None, None, None)],
                               "so2 double, no2 double, pm10 double, pm2_5 double")
    got = [r[0] for r in df.select(aqi_expr()).collect()]
    assert got[0] is None and got[1] == pytest.approx(12.5)


def test_tokens_only_number_survives(spark):
    vals = [" na ", "None", "", "  ", "x", "12.5", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(clean_double("s")).collect()]
    assert got == [None, None, None, None, None, 12.5, None]


def test_dates_four_layouts(spark):
    vals = ["2001-02-03", "03-02-2001", "02/03/2001", "2001/02/03", "junk", None, " NA "]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(parse_date("s")).collect()]
    assert got[:4] == [dt.date(2001, 2, 3)] * 4
    assert got[4:] == [None, None, None]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(min_value=-10, max_value=3000, allow_nan=False), min_size=1, max_size=30))
def test_sub_index_monotone_within_segments_and_bounded(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in sorted(xs)], "c double")
    for key, table in BREAKPOINTS.items():
        rows = df.select("c", sub_index("c", table).alias("s")).collect()
        for r in rows:
            if r["s"] is not None:
                assert 0.0 <= r["s"] <= 500.0
        for lo, hi, _, _ in table:
            seg = [r["s"] for r in rows if lo <= r["c"] <= hi and r["s"] is not None]
            assert all(a <= b + 1e-9 for a, b in zip(seg, seg[1:]))
            assert not any(math.isnan(v) for v in seg)
