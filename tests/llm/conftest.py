import os
import sys
import tempfile

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, TOP)
SF = "/root/testdata/sf0.001"

#: Rows every text operator must take: nulls, empty, blank, letterless, repeated, very long.
EDGE = [(1, None, "en", "a"), (2, "", "en", None), (3, " \t\n", None, "a"), (4, "12 34 !!", "de", "b"),
        (5, "one two three four five six", "en", "a"), (5, "one two three four five six", "en", "a"),
        (6, "one two three four five six", None, "c"), (7, "word " * 30_000, "en", "a"), (8, "x" * 50_000, "fr", "b"),
        (None, "ein Satz ohne Kennung", "de", "b")]


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from panelcast.llm.queries import ship
    s = (SparkSession.builder.master("local[4]").appName("panelcast-llm-tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="panelcast-llm-ckpt-")).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s


@pytest.fixture(scope="session")
def edge(spark):
    """The edge rows with further columns whose names clash with the operators' own."""
    rows = [(*r, "clash", 0.5, "k") for r in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, lang_pred string, score double, shard string").repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.filter("false")
