"""Fraud factors, gates, trust multipliers and verdicts at their bounds."""

import pytest
from pyspark.sql import functions as F

from trustlens.functions.scalars import verdict_of
from trustlens.operators import fraud as X
from trustlens.operators import trust as T
from trustlens.plans import scoring as P

NEUTRAL = dict(
    members=10_000, members_known=10_000, participants_count=10_000, avg_comments=3.0, forward_rate=1.0, comment_trust=0, reach=40.0, decay=1.1,
    decay_known=True, reactions_per_post=10.0, comments_enabled=True, viewed_posts=50, cv_views=40.0, total_reactions=500, simple_share=0.5,
    emoji_types=3, posts=50, gaps=49, interval_cv=0.8, rankable_posts=0, flat_posts=0, age_days=900, avg_views=4000.0, reaction_rate=2.0,
    is_verified=False, is_scam=False, is_fake=False, impossible=False,
)


def factor(spark, name, **values):
    frame = spark.createDataFrame([{**NEUTRAL, **values}])
    f = X.fraud_factors()[name]
    row = frame.select(f.weight.alias("w"), f.triggered.alias("t")).collect()[0]
    return row["w"], row["t"]


@pytest.mark.parametrize("name, values, expected", [
    ("impossible_reach", dict(reach=130.0), (0, False)), ("impossible_reach", dict(reach=130.1), (30, True)),
    ("impossible_reach", dict(reach=301.0), (35, True)), ("impossible_reach", dict(reach=301.0, forward_rate=3.1), (0, False)),
    ("impossible_reach", dict(reach=301.0, avg_comments=5.1, comment_trust=70), (0, False)),
    ("impossible_reach", dict(reach=301.0, avg_comments=5.1, comment_trust=69), (35, True)),
    ("impossible_reach", dict(reach=250.0, members=150), (0, False)), ("impossible_reach", dict(reach=181.0, members=999), (30, True)),
    ("flat_cv", dict(cv_views=9.9), (25, True)), ("flat_cv", dict(cv_views=10.0), (20, True)), ("flat_cv", dict(cv_views=15.0), (0, False)),
    ("flat_cv", dict(cv_views=1.0, viewed_posts=4), (0, False)),
    ("dead_engagement", dict(reactions_per_post=51.0, avg_comments=1.0), (20, True)),
    ("dead_engagement", dict(reactions_per_post=101.0, avg_comments=0.9), (20, True)),
    ("dead_engagement", dict(reactions_per_post=500.0, avg_comments=0.0, comments_enabled=False), (0, False)),
    ("dead_engagement", dict(reactions_per_post=50.0, avg_comments=0.0), (0, False)),
    ("no_decay", dict(decay=0.69), (15, True)), ("no_decay", dict(decay=0.7), (10, True)), ("no_decay", dict(decay=0.85), (0, False)),
    ("no_decay", dict(decay=0.5, decay_known=False), (0, False)),
    ("simple_reactions", dict(simple_share=0.96, emoji_types=2), (10, True)), ("simple_reactions", dict(simple_share=0.95, emoji_types=2), (0, False)),
    ("simple_reactions", dict(simple_share=1.0, emoji_types=3), (0, False)), ("simple_reactions", dict(simple_share=1.0, emoji_types=1, total_reactions=0), (0, False)),
    ("disabled_comments", dict(comments_enabled=False), (15, True)),
    ("bot_regularity", dict(interval_cv=0.149), (10, True)), ("bot_regularity", dict(interval_cv=0.15), (0, False)),
    ("bot_regularity", dict(interval_cv=0.1, gaps=4), (0, False)), ("bot_regularity", dict(interval_cv=0.1, posts=9), (0, False)),
    ("flat_reactions", dict(rankable_posts=4, flat_posts=3), (20, True)), ("flat_reactions", dict(rankable_posts=4, flat_posts=2), (0, False)),
    ("flat_reactions", dict(rankable_posts=2, flat_posts=2), (0, False)),
    ("extreme_reach_decay", dict(reach=201.0, decay=0.69), (25, True)), ("extreme_reach_decay", dict(reach=200.0, decay=0.69), (0, False)),
    ("high_reactions_low_comments", dict(reactions_per_post=501.0, avg_comments=4.9), (15, True)),
    ("high_reactions_low_comments", dict(reactions_per_post=501.0, avg_comments=5.0), (0, False)),
    ("suspicious_velocity", dict(members=100_000, age_days=89), (25, True)), ("suspicious_velocity", dict(members=100_000, age_days=99), (20, True)),
    ("suspicious_velocity", dict(members=30_000, age_days=80), (10, True)), ("suspicious_velocity", dict(members=36_000, age_days=100), (5, True)),
    ("suspicious_velocity", dict(members=30_000, age_days=100), (0, False)),
    ("effective_members", dict(avg_views=449.0), (25, True)), ("effective_members", dict(avg_views=451.0), (10, True)),
    ("effective_members", dict(avg_views=751.0), (0, False)), ("effective_members", dict(avg_views=0.0), (0, False)),
    ("young_fast_inactive", dict(age_days=59, reaction_rate=0.9), (30, True)), ("young_fast_inactive", dict(age_days=59, avg_comments=0.4), (30, True)),
    ("young_fast_inactive", dict(age_days=59), (0, False)), ("young_fast_inactive", dict(age_days=60, reaction_rate=0.9), (0, False)),
])
def test_factor(spark, name, values, expected):
    assert factor(spark, name, **values) == expected


def test_conviction_rules(spark):
    cases = [
        (dict(), 0, False), (dict(comments_enabled=False, cv_views=9.0), 40, False),
        (dict(comments_enabled=False, reach=301.0), 50, True), (dict(comments_enabled=False, reach=301.0, is_verified=True), 30, False),
        (dict(reach=301.0, cv_views=5.0, decay=0.6, is_verified=True, forward_rate=1.0), 80, True),
    ]
    for values, effective, scam in cases:
        row = X.add_conviction(spark.createDataFrame([{**NEUTRAL, **values}])).collect()[0]
        assert (row["effective_conviction"], row["conviction_scam"]) == (effective, scam), values


@pytest.mark.parametrize("values, expected", [
    (dict(posts=9), "insufficient_data"), (dict(posts=10), None), (dict(participants_count=99), "insufficient_data"),
    (dict(participants_count=0, members_known=99), "insufficient_data"), (dict(participants_count=0, members_known=100), None),
    (dict(is_scam=True), "flagged_scam"), (dict(is_fake=True), "flagged_fake"), (dict(viewed_posts=0), "no_views"), (dict(impossible=True), "impossible_counts"),
    (dict(posts=9, is_scam=True), "insufficient_data"),
])
def test_gates(spark, values, expected):
    assert spark.createDataFrame([{**NEUTRAL, **values}]).select(X.gate().alias("g")).collect()[0]["g"] == expected


def column(spark, value, schema="v double"):
    return spark.createDataFrame(value, schema)


def test_ladders(spark):
    frame = spark.createDataFrame([(i, p) for i, p in enumerate([None, 20, 21, 30, 31, 40, 41, 50, 51, 60, 61, 70, 71, 80, 81])], "i int, p int")
    got = frame.select("i", T.ad_multiplier(F.col("p")).alias("a"), T.ad_multiplier(F.col("p"), "rescore").alias("r"), T.bot_multiplier(F.col("p")).alias("b")).orderBy("i").collect()
    assert [r["a"] for r in got] == [1, 1, 1, 1, .9, .9, .75, .75, .55, .55, .4, .4, .35, .35, .35]
    assert [r["r"] for r in got] == [1, 1, .95, .95, .95, .95, .85, .85, .85, .85, .7, .7, .7, .7, .5]
    assert [round(r["b"], 2) for r in got] == [1, 1, 1, 1, 1, 1, .99, .9, .89, .8, .79, .7, .69, .6, .59]


def test_ghost_and_discrepancy(spark):
    frame = spark.createDataFrame([(0, 20_001, 20, 20_001), (1, 20_001, 21, 20_001), (2, 5_001, 15, 5_502), (3, 5_000, 1, 5_500), (4, 30_000, 0, 0), (5, 20_000, 10, 22_001)],
                                  "i int, m long, o long, p long")
    got = frame.select("i", T.ghost(F.col("m"), F.col("o")).alias("g"), T.discrepancy(F.col("m"), F.col("p")).alias("d")).orderBy("i").collect()
    assert [r["g"] for r in got] == [.5, .7, .7, 1, 1, .7]
    assert [r["d"] for r in got] == [1, 1, .8, 1, 1, .8]


def test_safety(spark):
    cases = [(True, "CRITICAL", "SCAM", "TECH", 0.0, "EXCLUDED", 0), (True, "HIGH", "SCAM", "TECH", 0.3, "RESTRICTED", 30), (True, "MEDIUM", "SCAM", "TECH", 0.7, "STANDARD", 85),
             (False, "CRITICAL", "SCAM", "TECH", 1.0, "STANDARD", 85), (True, "CRITICAL", "GAMBLING", "CRYPTO", 1.0, "STANDARD", 85), (True, "HIGH", "GAMBLING", None, 0.3, "RESTRICTED", 30)]
    frame = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, toxic boolean, severity string, kind string, category string")
    s = T.safety_tier(F.col("toxic"), F.col("severity"), F.col("kind"), F.col("category"))
    got = frame.select("i", *[c.alias(n) for n, c in s.items()]).orderBy("i").collect()
    assert [(r["safety_multiplier"], r["tier"], r["tier_cap"]) for r in got] == [c[4:] for c in cases]


def test_verdicts(spark):
    frame = spark.createDataFrame([(i, s) for i, s in enumerate([100, 75, 74, 55, 54, 40, 39, 25, 24, 0])], "i int, s int")
    got = [r["v"] for r in frame.select("i", verdict_of(F.col("s")).alias("v")).orderBy("i").collect()]
    assert got == ["EXCELLENT", "EXCELLENT", "GOOD", "GOOD", "MEDIUM", "MEDIUM", "HIGH_RISK", "HIGH_RISK", "SCAM", "SCAM"]


def test_scoring_invariants(spark):
    from trustlens.sources.samples import SampleTables, as_of

    t = SampleTables(spark, "/root/testdata/sf0.001")
    extra = t.channels.limit(1).withColumn("channel_id", F.lit(10**9).cast("bigint")).withColumn("llm", F.lit(None).cast(t.channels.schema["llm"].dataType))
    channels = t.channels.unionByName(extra)
    scored = P.score_channels(t.posts_with_text, channels, t.audience, as_of()).collect()
    assert len(scored) == channels.count()
    for r in scored:
        assert 0 <= r["score"] <= 100 and 0.1 <= r["trust"] <= 1.0
        assert r["verdict"] != "NEW_CHANNEL" or r["score"] == 0
    newcomer = next(r for r in scored if r["channel_id"] == 10**9)
    assert newcomer["verdict"] == "NEW_CHANNEL" and newcomer["tier"] is None and newcomer["llm_trust"] == 1.0
