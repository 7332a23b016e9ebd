"""Import of both stored formats and re-scoring of what was imported."""

from datetime import datetime

import pytest

from trustlens.plans import presentation as PS
from trustlens.plans import rescore as RS
from trustlens.sources import stored_rows as R

SCHEMA = """username string, members long, score int, trust_factor double, verdict string, status string, category string, online_count long,
participants_count long, comments_enabled boolean, ad_percentage int, bot_percentage int, scanned_at timestamp, breakdown_json string, forensics_json string,
avg_views long"""
DEFAULT = dict(
    username="a", members=10_000, score=50, trust_factor=0.8, verdict="MEDIUM", status="GOOD", category="TECH", online_count=300, participants_count=10_000,
    comments_enabled=True, ad_percentage=0, bot_percentage=0, scanned_at=datetime(2024, 1, 1), breakdown_json=None, forensics_json=None, avg_views=None,
)
LONG = """{"breakdown": {"cv_views": {"value": 45.2, "points": 12, "max": 12}, "reach": {"value": 30.5, "points": 6, "max": 8}, "regularity": {"value": 2.0, "points": 7, "max": 7},
"forward_rate": {"value": 1.2, "points": 12, "max": 15}, "comments": {"value": "enabled (avg 3.4)", "points": 12, "max": 15}, "er_trend": {"status": "growing", "points": 10},
"reaction_rate": {"value": 2.0, "points": 6, "max": 8}, "reaction_stability": {"value": 40.0, "points": 5, "max": 5}, "age": {"value": 800, "points": 7, "max": 7},
"premium": {"value": 6.0, "ratio": 0.06, "count": 6, "points": 7, "max": 7}, "source_diversity": {"value": 1.0, "points": 6, "max": 6, "repost_ratio": 0.05}}}"""
SHORT = """{"breakdown": {"_v": 1, "cv": [45.2, 12], "re": [30.5, 6], "rg": [2.0, 7], "fr": [1.2, 12], "co": ["enabled (avg 3.4)", 12], "er": {"status": "growing", "points": 10},
"rr": [2.0, 6], "rs": [40.0, 5], "ag": [800, 7], "pr": [6.0, 7], "sd": [1.0, 6]}}"""


def table(spark, *changes):
    columns = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(",")]
    return spark.createDataFrame([tuple({**DEFAULT, **c}[k.strip()] for k in columns) for c in changes], SCHEMA)


def one(spark, **change):
    return R.import_rows(table(spark, change))


def test_formats_agree(spark):
    long, short = one(spark, breakdown_json=LONG).collect()[0], one(spark, breakdown_json=SHORT).collect()[0]
    assert not long["short_format"] and short["short_format"]
    for metric in ("cv_views", "reach", "regularity", "forward_rate", "reaction_rate", "age"):
        assert long["m"][metric] == short["m"][metric], metric
    assert long["m"]["comments"]["value"] == short["m"]["comments"]["value"] and short["m"]["premium"]["max"] == 7


def test_short_key_without_marker(spark):
    assert one(spark, breakdown_json='{"breakdown": {"cv": [1.0, 2]}}').collect()[0]["short_format"]


def test_private_links_under_premium_key(spark):
    row = one(spark, breakdown_json='{"breakdown": {"_v": 1, "pr": {"private_ratio": 0.7}}}').collect()[0]
    assert row["m"]["private_ratio"] == 0.7 and row["m"]["premium"] is None


@pytest.mark.parametrize("text", [None, "", "not json", "{}", '{"breakdown": null}'])
def test_nothing_stored(spark, text):
    imported = one(spark, breakdown_json=text)
    assert not imported.collect()[0]["has_metrics"]
    diff = RS.rescore_diff(imported).collect()[0]
    assert (diff["new_score"], diff["new_trust"], diff["new_verdict"], diff["changed"]) == (50, 0.8, "MEDIUM", False)


@pytest.mark.parametrize("key", ["geo_dc_check", "geo_dc_analysis"])
def test_foreign_share_under_both_keys(spark, key):
    imported = one(spark, breakdown_json=LONG, forensics_json='{"users_analyzed": 20, "%s": {"foreign_ratio": 0.9}, "premium_density": {"premium_count": 1}}' % key)
    rated = RS.unified_trust(RS.trust_input(imported)).collect()[0]
    assert [p["key"] for p in rated["penalties"]] == ["geo_dc_mismatch"] and rated["new_trust"] == 0.2


@pytest.mark.parametrize("entry, trust", [('{"neighbor_ratio": 0.31}', 0.0), ('{"neighbor_ratio": 0.3}', 0.5), ('{"neighbor_ratio": 0.15}', 1.0),
                                          ('{"percentage": 40}', 0.0), ('{"fatality": true}', 0.0)])
def test_farm_takes_trust_to_zero(spark, entry, trust):
    imported = one(spark, breakdown_json=LONG, forensics_json='{"users_analyzed": 20, "premium_density": {"premium_count": 1}, "id_clustering": %s}' % entry)
    assert RS.unified_trust(RS.trust_input(imported)).collect()[0]["new_trust"] == trust


def test_raw_score_and_diff(spark):
    row = RS.rescore_diff(one(spark, breakdown_json=LONG)).collect()[0]
    assert row["stored_raw"] == 12 + 6 + 12 + 7 + 12 + 6 + 5 + 10 + 7 + 7 + 6 == 90
    assert row["new_trust"] == 1.0 and row["new_score"] == 90 and row["changed"] and row["new_verdict"] == "EXCELLENT"


def test_stored_trust(spark):
    details = '{"a": {"multiplier": 0.5}, "b": {"multiplier": 0.9}, "c": {"multiplier": 1.0}, "d": {"reason": "x"}}'
    text = '{"breakdown": {"trust_details": %s}, "llm_analysis": {"llm_trust_factor": %s}}'
    got = [RS.stored_trust(one(spark, breakdown_json=text % (details, llm))).collect()[0]["stored_trust"] for llm in ("0.5", "1.0", "0.1", "0")]
    assert got == [pytest.approx(0.22), 0.45, 0.1, 0.45]


def test_bulk_truncates_and_skips(spark):
    frame = R.import_rows(table(spark, dict(breakdown_json=LONG), dict(username="b", breakdown_json=LONG, status="WAITING"), dict(username="c", breakdown_json="broken")))
    got = RS.rescore_all(frame).collect()
    assert [(r["username"], r["new_score"], r["new_status"]) for r in got] == [("a", 90, "GOOD")]
    summary = RS.run_summary(frame).collect()[0]
    assert (summary["total"], summary["updated"], summary["errors"], summary["changed"]) == (2, 1, 1, 1)


def test_quick_stats_and_average(spark):
    for text in (LONG, SHORT):
        row = R.quick_stats(one(spark, breakdown_json=text)).collect()[0]
        assert (row["quick_reach"], row["quick_err"], row["quick_comments"]) == (30.5, 2.0, 3.4)


@pytest.mark.parametrize("flags, verified", [('"flags": {"is_verified": false},', False), ("", True)])
def test_flags_win(spark, flags, verified):
    text = '{%s "breakdown": {"verified": {"value": true}}}' % flags
    frame = one(spark, breakdown_json=text)
    assert frame.select(R.stored_verified(frame["breakdown_json"]).alias("v")).collect()[0]["v"] is verified


def test_disabled_metric_is_marked(spark):
    text = '{"breakdown": {"reaction_rate": {"value": 1.0, "points": 0, "max": 0}, "comments": {"value": "disabled", "points": 0, "max": 0}}}'
    rows = {r["metric"]: r for r in PS.shown_breakdown(one(spark, breakdown_json=text)).collect()}
    assert rows["reaction_rate"]["disabled"] and rows["comments"]["disabled"] and not rows["reach"]["disabled"] and len(rows) == 11


def test_estimated_breakdown_adds_up(spark):
    frame = spark.createDataFrame([(f"u{s}", s, t) for s in range(0, 101, 9) for t in (0.5, 1.0)], "username string, score int, trust_factor double")
    for r in PS.estimated_breakdown(frame).collect():
        assert 0 <= r["score"] <= r["max"]


def test_price_floor_and_bands(spark):
    frame = table(spark, dict(score=90, trust_factor=1.0, avg_views=10_000), dict(username="b", score=10, trust_factor=0.1, members=50, category=None))
    got = {r["username"]: r for r in PS.channel_details(frame).collect()}
    assert got["a"]["cpm"] == 1000 and (got["a"]["price_min"], got["a"]["price_max"]) == (9000, 11000)
    assert (got["b"]["price_min"], got["b"]["price_max"]) == (100, 200) and got["b"]["price_category"] == "OTHER"
