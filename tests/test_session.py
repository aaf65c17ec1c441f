"""Session helper and tables of the shared folder."""

import os

import pytest
from pyspark.sql import functions as F

from panelcast.session import checkpoint_dir, cut_lineage, get_session, scratch_path, staged


def test_get_session_takes_the_active_one(spark):
    assert get_session("other", master="local[1]") is spark
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_get_session_builds_one(monkeypatch):
    """Without an active session one is built with the defaults, the caller's settings over them."""
    import panelcast.session as session

    class Builder:
        made = {}

        def appName(self, name):
            self.made["app"] = name
            return self

        def master(self, url):
            self.made["master"] = url
            return self

        def config(self, key, value):
            self.made[key] = value
            return self

        def getOrCreate(self):
            return self.made

    class Session:
        builder = Builder()

        @staticmethod
        def getActiveSession():
            return None

    monkeypatch.setattr(session, "SparkSession", Session)
    made = session.get_session("mine", "yarn", {"spark.sql.session.timeZone": "CET"})
    assert made["app"] == "mine" and made["master"] == "yarn" and made["spark.sql.session.timeZone"] == "CET"
    assert made["spark.ui.enabled"] == "false" and made["spark.sql.adaptive.enabled"] == "true"
    Builder.made = {}
    assert "master" not in session.get_session()


def test_staged_tables(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string").withColumn("c", F.rand(3))
    back = staged(df, "t", 3)
    assert back.dtypes == df.dtypes and sorted(back.collect(), key=str) == sorted(back.collect(), key=str)
    assert back.count() == 2 and staged(df.filter("false")).count() == 0
    assert scratch_path(spark, "x") != scratch_path(spark, "x") and scratch_path(spark, "x").startswith(os.path.join(checkpoint_dir(spark), "x-"))
    assert cut_lineage(df).count() == 2


def test_queries_leave_no_cached_tables(spark):
    import __spark_entry__ as entry

    from conftest import SF001
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for name in ("feature_table", "leak_free_features", "metrics_by_entity_roundtrip", "metrics_by_entity_roundtrip"):
        assert entry.queries()[name](spark, SF001).count() > 0
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


@pytest.mark.parametrize("extra", [(), ("city",)])
def test_metrics_schema_is_made_anew(extra):
    from panelcast.sources.sinks import metrics_schema
    metrics_schema().add("more", "string")
    assert metrics_schema(*extra).names == ["model", "RMSE", "MAE", "MAPE", "R2", "training_time_sec", *extra]
