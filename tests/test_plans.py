"""Shape of the physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from trustlens.operators.audience import neighbour_pairs
from trustlens.operators.catalogue import catalogue_filter
from trustlens.operators.channel_metrics import channel_metrics
from trustlens.plans import rescore as RS
from trustlens.plans.scoring import score_channels
from trustlens.sources import stored_rows as R
from trustlens.sources.samples import SampleTables, as_of


@pytest.fixture(scope="module")
def t(spark):
    return SampleTables(spark, "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"\bExchange hashpartitioning", text))


def test_no_window_holds_the_posts_of_a_channel(t):
    text = plan(channel_metrics(t.posts))
    windows = [line for line in text.splitlines() if "windowspecdefinition" in line]
    assert windows and all("own bucket" in line for line in windows if "post_id" in line), "posts are placed within a day of their channel"


def test_no_python_no_product(t):
    text = plan(score_channels(t.posts_with_text, t.channels, t.audience, as_of()))
    for word in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


def test_text_does_not_travel_with_the_posts(t):
    scored = score_channels(t.posts_with_text, t.channels, t.audience, as_of())
    for line in plan(scored).splitlines():
        if "windowspecdefinition" in line and "own bucket" in line:
            assert "body" not in line and "text" not in line


def test_rescore_does_not_shuffle(spark, t, tmp_path):
    path = str(tmp_path / "stored")
    t.stored.write.parquet(path)
    stored = spark.read.parquet(path)
    for df in (RS.rescore_diff(R.import_rows(stored)), RS.rescore_all(R.import_rows(stored))):
        assert "Exchange" not in plan(df)


def test_neighbours_have_no_window(t):
    text = plan(neighbour_pairs(t.audience))
    assert "Window" not in text and exchanges(text) == 3


def test_catalogue_predicates_reach_the_scan(spark, t, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    path = str(tmp_path / "results")
    t.results.write.parquet(path)
    page = catalogue_filter(spark.read.parquet(path), 20, 90, 500, verdict="good_plus").orderBy(F.col("score").desc(), "username").limit(5)
    text = page.select("username", "score")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text
    assert "PushedFilters" in text and "GreaterThanOrEqual(score,20)" in text and "In(status" in text
    assert "description" not in text.split("ReadSchema")[1]
