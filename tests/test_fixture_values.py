"""Expected values of the readings adapter at sf0.01 (FIXTURES.md §2)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E

from conftest import SF01


@pytest.fixture(scope="module")
def clean(spark):
    return E._clean(spark, SF01).persist()


def test_rows_and_unparsed_dates(clean):
    assert clean.count() == 60000
    assert clean.filter(F.col("date_parsed").isNull()).count() == 586


def test_medians(spark):
    m = E.q_median_values(spark, SF01).first().asDict()
    assert m == {"so2": 25.0, "no2": 50.0, "pm10": 265.0, "pm2_5": 166.0}


def test_null_aqi_with_and_without_imputation(spark):
    assert E._indexed(spark, SF01, impute=False).filter("AQI IS NULL").count() == 63
    assert E._indexed(spark, SF01).filter("AQI IS NULL").count() == 0


def test_aqi_quartiles(spark):
    a = E._indexed(spark, SF01)
    r = a.agg(F.min("AQI"), F.percentile_approx("AQI", [0.25, 0.75], 1000000), F.max("AQI")).first()
    assert r[0] == 12.5 and r[2] == pytest.approx(456.0323529411765)
    assert r[1][0] == pytest.approx(334.3837209302326) and r[1][1] == pytest.approx(402.45588235294116)


def test_rows_with_target(spark):
    assert E.q_forecast_target_readings(spark, SF01).count() == 59314


def test_year_split_clamp(spark):
    rows = {r["split"]: r for r in E.q_chrono_split_years(spark, SF01).collect()}
    assert rows["train"]["last_date"].year == 1999 and rows["test"]["first_date"].year == 2000
