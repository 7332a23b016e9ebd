"""Trust multipliers. One definition per penalty; the scan and re-score profiles differ in a few ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustlens.functions.scalars import ladder_down
from trustlens.operators.channel_metrics import posting_tier
from trustlens.operators.fraud import has_alibi

def penalty(condition: Column, multiplier) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(multiplier)).otherwise(F.lit(1.0))


def clustering(ratio: Column, fatal: Column) -> Column:
    return F.when(fatal, 0.0).when(ratio > 0.15, 0.5).otherwise(1.0)


def conviction(effective: Column) -> Column:
    return F.when(effective >= 70, 0.3).when(effective >= 50, 0.6).otherwise(1.0)


def ghost(members: Column, online: Column) -> Column:
    share = online / F.nullif(members, F.lit(0)).cast("double") * 100
    seen = online > 0
    return (
        F.when((members > 20000) & seen & (share < 0.1), 0.5).when((members > 5000) & seen & (share < 0.3), 0.7).otherwise(1.0)
    )


def detail_key(name: str, multiplier: Column) -> Column:
    """Key under which a multiplier is listed; the two steps of a low online share have keys of their own."""
    return F.when(multiplier < 0.6, "ghost_channel").otherwise("zombie_audience") if name == "online" else F.lit(name)


def discrepancy(members: Column, participants: Column) -> Column:
    gap = F.abs(participants - members).cast("double") / F.nullif(members, F.lit(0)).cast("double") * 100
    return penalty((participants > 0) & (members > 0) & (gap > 10), 0.8)


def dying(status: Column, decay: Column) -> Column:
    return F.when(status == "dying", F.when(decay.between(0.7, 1.3), 0.6).otherwise(0.75)).otherwise(1.0)


def network(scam: Column, bad: Column) -> Column:
    return F.when(
        (scam > 0) | (bad > 0),
        F.bround(F.pow(F.lit(0.9), scam.cast("double")) * F.pow(F.lit(0.95), bad.cast("double")), 2),
    ).otherwise(1.0)


def scan_multipliers() -> dict[str, Column]:
    """Multipliers of the scan profile, in the order in which they are applied."""
    c = F.col
    complete = c("complete")
    return {
        "id_clustering": F.when(complete, clustering(c("neighbour_raw"), c("clustered"))).otherwise(1.0),
        "geo_dc": penalty(complete & c("geo_mismatch"), 0.2),
        "premium": penalty(complete & (c("premium_ratio") == 0), 0.8),
        "hidden_comments": penalty(~c("comments_enabled"), 0.85),
        "conviction": conviction(c("effective_conviction")),
        "hollow_views": penalty((c("reach") > 300) & ~has_alibi(), 0.6),
        "zombie_engagement": penalty((c("reach") > 50) & (c("reaction_rate") < 0.1), 0.7),
        "satellite": penalty((c("source_share") * 100 > 50) & (c("avg_comments") < 1), 0.8),
        "online": ghost(c("members"), c("online_count")),
        "member_discrepancy": discrepancy(c("members"), c("participants_count")),
        "budget_cliff": penalty((c("decay") < 0.2) & (c("decay") > 0), 0.7),
        "spam_posting": c("posting_multiplier"),
        "private_links": c("private_multiplier"),
        "dying_engagement": dying(c("er_status"), c("decay")),
    }


def rescore_posting(posts_per_day: Column, category: Column) -> Column:
    active, heavy, spam = posting_tier(category)
    return (
        F.when(posts_per_day > spam, 0.55).when(posts_per_day > heavy, 0.75).when(posts_per_day > active, 0.90).otherwise(1.0)
    )


def rescore_private(ratio: Column, category: Column, comments_on: Column) -> dict[str, Column]:
    return {
        "private_links": F.when(ratio >= 1.0, 0.25).when(ratio > 0.8, 0.35).when(ratio > 0.6, 0.50).otherwise(1.0),
        "private_crypto_combo": penalty((category == "CRYPTO") & (ratio > 0.4), 0.45),
        "private_hidden_combo": penalty(~comments_on & (ratio > 0.5), 0.40),
    }


def bot_multiplier(percentage: Column) -> Column:
    return F.when(
        percentage > 40, F.greatest(F.lit(0.3), F.lit(1.0) - (percentage - 40) / 100.0)
    ).otherwise(1.0)


def ad_multiplier(percentage: Column, profile: str = "scan") -> Column:
    if profile == "scan":
        bounds = [(70, 0.35), (60, 0.40), (50, 0.55), (40, 0.75), (30, 0.90)]
    else:
        bounds = [(80, 0.50), (60, 0.70), (40, 0.85), (20, 0.95)]
    return ladder_down(percentage, bounds, 1.0, inclusive=False)


def rescore_multipliers() -> dict[str, Column]:
    """Multipliers of the re-score profile over stored values; missing values are 0 or neutral."""
    c = F.col

    def known(name: str, default=0) -> Column:
        return F.coalesce(c(name), F.lit(default))

    members, online = known("members"), known("online_count")
    decay, comments_on = known("views_decay", 1.0), known("comments_enabled", True)
    quiet = known("avg_comments", 0.0) < 1
    return {
        "id_clustering": clustering(
            known("neighbour_ratio", 0.0), known("clustered", False) | (known("neighbour_ratio", 0.0) > 0.30)
        ),
        "geo_dc_mismatch": penalty(known("foreign_ratio", 0.0) > 0.75, 0.2),
        "premium_zero": penalty((known("users_analyzed") >= 10) & (known("premium_count") == 0), 0.8),
        "bot_penalty": bot_multiplier(known("bot_percentage")),
        "ad_penalty": ad_multiplier(known("ad_percentage"), "rescore"),
        "conviction": conviction(known("conviction_score")),
        "hollow_views": penalty((known("reach", 0.0) > 300) & (known("forward_rate", 0.0) < 3.0) & quiet, 0.6),
        "zombie_engagement": penalty((known("reach", 0.0) > 50) & (known("reaction_rate", 0.0) < 0.1), 0.7),
        "satellite": penalty((known("source_max_share", 0.0) > 0.5) & quiet, 0.8),
        "online": ghost(members, online),
        "member_discrepancy": discrepancy(members, known("participants_count")),
        "budget_cliff": penalty(decay < 0.2, 0.7),
        "spam_posting": rescore_posting(known("posts_per_day", 0.0), c("category")),
        **rescore_private(known("private_ratio", 0.0), c("category"), comments_on),
        "hidden_comments": penalty(~comments_on, 0.85),
        "dying_engagement": dying(c("er_status"), decay),
        "scam_network": network(known("scam_count"), known("bad_count")),
    }


def safety_tier(toxic: Column, severity: Column, toxic_category: Column, category: Column) -> dict[str, Column]:
    """Brand-safety multiplier, tier and score cap. Gambling flags are ignored for trading channels."""
    trading = (toxic_category == "GAMBLING") & category.isin("CRYPTO", "FINANCE")
    counts = F.coalesce(toxic, F.lit(False)) & ~F.coalesce(trading, F.lit(False))
    return {
        "safety_multiplier": F.when(counts & (severity == "CRITICAL"), 0.0).when(counts & (severity == "HIGH"), 0.3)
        .when(counts & (severity == "MEDIUM"), 0.7).otherwise(1.0),
        "tier": F.when(counts & (severity == "CRITICAL"), "EXCLUDED").when(counts & (severity == "HIGH"), "RESTRICTED")
        .otherwise("STANDARD"),
        "tier_cap": F.when(counts & (severity == "CRITICAL"), 0).when(counts & (severity == "HIGH"), 30).otherwise(85),
        "exclusion_reason": F.when(
            counts & (severity == "CRITICAL"), F.concat(F.lit("TOXIC_"), F.coalesce(toxic_category, F.lit("CONTENT")))
        ),
    }


def llm_trust(ad: Column, bot: Column, safety: Column) -> Column:
    """Combined model-based trust, at least .15 unless the channel is excluded."""
    return F.when(safety == 0.0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.15), ad * bot * safety))
