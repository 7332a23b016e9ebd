"""Fraud factors, gates, trust multipliers and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.queries import Query
from trustlens.functions.scalars import half_even
from trustlens.operators import fraud as X
from trustlens.operators import network as N
from trustlens.operators import trust as T
from trustlens.plans import scoring as P
from trustlens.sources.samples import as_of

QUERIES: dict[str, Query] = {}

FACTORS = [
    "impossible_reach", "flat_cv", "dead_engagement", "no_decay", "simple_reactions", "disabled_comments", "bot_regularity",
    "flat_reactions", "extreme_reach_decay", "high_reactions_low_comments", "suspicious_velocity", "effective_members",
    "young_fast_inactive",
]


def query(name: str):
    def add(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return add


def rated(t):
    return P.rated_metrics(t.posts, t.channels, as_of())


def scored(t):
    return P.score_channels(t.posts_with_text, t.channels, t.audience, as_of())


def pointed(t):
    return P.add_points(P.with_forensics(rated(t), t.audience))


def factor_query(name: str):
    def build(t):
        factor = X.fraud_factors()[name]
        return rated(t).select("channel_id", factor.weight.alias("weight"), factor.triggered.alias("triggered"))

    return build


for number, factor_name in enumerate(FACTORS, start=1):
    QUERIES[f"FRD-{number:02d}"] = factor_query(factor_name)

QUERIES["FRD-14"] = lambda t: rated(t).select("channel_id", X.mitigation().alias("mitigation"))
QUERIES["FRD-15"] = lambda t: X.add_conviction(rated(t)).select(
    "channel_id", "conviction", "factors_triggered", "mitigation", "effective_conviction", "conviction_scam",
    F.array_join(F.transform(F.filter("factors", lambda f: f["triggered"]), lambda f: f["name"]), ",").alias("reasons"),
)


def gate_query(*gates: str):
    return lambda t: rated(t).withColumn("gate", X.gate()).where(F.col("gate").isin(*gates)).select("channel_id", "gate")


QUERIES["GAT-01"] = lambda t: rated(t).withColumn("gate", X.gate()).select(
    "channel_id", F.coalesce(F.col("gate") == "insufficient_data", F.lit(False)).alias("new_channel"))
QUERIES["GAT-02"] = gate_query("flagged_scam", "flagged_fake")
QUERIES["GAT-03"] = lambda t: rated(t).withColumn("gate", X.gate()).select(
    "channel_id", "viewed_posts", F.coalesce(F.col("gate") == "no_views", F.lit(False)).alias("no_views"))
QUERIES["GAT-04"] = gate_query("impossible_counts")


def multiplier_query(key: str):
    def build(t):
        posts = t.posts_with_text if key == "private_links" else t.posts
        convicted = P.convicted_channels(posts, t.channels, t.audience, as_of())
        return convicted.select("channel_id", T.scan_multipliers()[key].alias("multiplier"))

    return build


for number, key in {
    1: "id_clustering", 2: "geo_dc", 3: "premium", 4: "hidden_comments", 5: "conviction", 6: "hollow_views", 7: "zombie_engagement",
    8: "satellite", 9: "online", 10: "member_discrepancy", 11: "budget_cliff", 12: "spam_posting", 14: "private_links",
    15: "dying_engagement",
}.items():
    QUERIES[f"TRU-{number:02d}"] = multiplier_query(key)


@query("TRU-13")
def _(t):
    return N.neighbour_risk(t.results).select("channel_id", T.network(F.col("scam_count"), F.col("bad_count")).alias("multiplier"))


@query("TRU-16")
def _(t):
    few = t.audience.where("user_id % 37 = 0")
    return P.score_channels(t.posts_with_text, t.channels, few, as_of()).select(
        "channel_id", "scoring_mode", "flatness_on", F.round("trust", 6).alias("trust")
    )


@query("TRU-16b")
def _(t):
    return P.score_channels(t.posts_with_text, t.channels, t.audience, as_of()).select(
        "channel_id", "scoring_mode", "flatness_on", F.round("trust", 6).alias("trust")
    )


@query("TRU-17")
def _(t):
    return t.channels.select("channel_id", F.round(T.bot_multiplier(F.col("llm.bot_percentage")), 4).alias("multiplier"))


@query("TRU-18")
def _(t):
    ad = F.col("llm.ad_percentage")
    return t.channels.select(
        "channel_id", T.ad_multiplier(ad).alias("scan_multiplier"), T.ad_multiplier(ad, "rescore").alias("rescore_multiplier")
    )


@query("TRU-19")
def _(t):
    return P.add_llm_trust(t.channels).select(
        "channel_id", "safety_multiplier", "tier", "tier_cap", "exclusion_reason", F.round("llm_trust", 4).alias("llm_trust")
    )


QUERIES["AGG-35"] = lambda t: scored(t).select(
    "channel_id", F.round("trust_product", 6).alias("trust_product"),
    F.array_join(F.transform("trust_details", lambda d: d["key"]), ",").alias("penalties"),
)
QUERIES["SCO-01"] = lambda t: pointed(t).select(
    "channel_id", "quality", "quality_max", "engagement", "engagement_max", "reputation", "reputation_max")
QUERIES["SCO-02"] = lambda t: pointed(t).select("channel_id", "raw_score")
QUERIES["SCO-03"] = lambda t: scored(t).select("channel_id", "score")
QUERIES["SCO-04"] = lambda t: scored(t).select("channel_id", "scam_flag", "verdict")
QUERIES["SCO-05"] = lambda t: scored(t).select("channel_id", "trust_factor", half_even(F.col("llm_trust"), 2).alias("llm_trust_factor"))


@query("SCO-06")
def _(t):
    return P.add_crawl_outcome(scored(t)).select("channel_id", "status", "outcome_status", "outcome_verdict", "outcome_score", "retry")
