"""The full scoring plan: samples of every channel to score, verdict and status in one query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlens.constants import CATEGORY_MAX, GOOD_SCORE
from trustlens.functions import points as P
from trustlens.functions.scalars import age_days, clamp, half_even, product, safe_ratio, verdict_of
from trustlens.operators import trust as T
from trustlens.operators.audience import forensics
from trustlens.operators.channel_metrics import channel_metrics, posting_multiplier, posting_status, private_links
from trustlens.operators.fraud import add_conviction, gate

METRIC_DEFAULTS = {
    "posts": 0, "viewed_posts": 0, "total_views": 0, "total_reactions": 0, "total_forwards": 0,
}


def rated_metrics(posts: DataFrame, channels: DataFrame, as_of: Column) -> DataFrame:
    """Channel attributes joined with their metrics and the values derived from both.

    Every channel keeps its row: one without posts fails the data gate later.
    """
    joined = channels.join(channel_metrics(posts), "channel_id", "left").fillna(METRIC_DEFAULTS)
    joined = joined.withColumns({
        "members_known": F.coalesce("members", F.lit(0)),
        "members": F.coalesce(F.nullif("members", F.lit(0)), F.lit(1)),
        "comments_enabled": F.coalesce("comments_enabled", F.lit(False)),
        "is_verified": F.coalesce("is_verified", F.lit(False)),
        "online_count": F.coalesce("online_count", F.lit(0)),
        "participants_count": F.coalesce("participants_count", F.lit(0)),
        "reactions_on": F.coalesce("reactions_on", F.lit(True)),
        "er_status": F.coalesce("er_status", F.lit("insufficient_data")),
        "decay": F.coalesce("decay", F.lit(1.0)),
        "comment_trust": F.coalesce("llm.comment_trust", F.lit(0)),
        "age_days": age_days(F.col("created_at"), as_of),
    })
    rated = joined.withColumns({
        "reach": safe_ratio(F.col("avg_views"), F.col("members"), 100),
        "posting_status": posting_status(F.col("posts_per_day_raw"), F.col("category"), F.col("dated")),
    }).withColumn("posting_multiplier", posting_multiplier(F.col("posting_status")))
    if "private_posts" in rated.columns:
        rated = private_links(rated, F.col("category"), F.col("comments_enabled"))
    return rated


def with_forensics(rated: DataFrame, audience: DataFrame) -> DataFrame:
    joined = rated.join(forensics(audience), "channel_id", "left")
    return joined.withColumns({
        "accounts": F.coalesce("accounts", F.lit(0)),
        "complete": F.coalesce("complete", F.lit(False)),
        "clustered": F.coalesce("clustered", F.lit(False)),
        "premium_ratio": F.coalesce("premium_ratio", F.lit(0.0)),
        "premium_count": F.coalesce("premium_count", F.lit(0)),
    })


def add_points(rated: DataFrame) -> DataFrame:
    """Points of the eleven scored metrics, category subtotals with floating maxima, and the raw score."""
    c = F.col
    comments_on, reactions_on = c("comments_enabled"), c("reactions_on")

    def maximum(position: int) -> Column:
        return P.floating(comments_on, reactions_on, lambda *m: F.lit(m[position]))

    pointed = rated.withColumns({
        "comments_max": maximum(0), "reactions_max": maximum(1), "forwards_max": maximum(2),
        "cv_points": P.cv_points(c("cv_views"), c("forward_rate")),
        "reach_points": P.reach_points(c("reach"), c("members")),
        "regularity_points": P.regularity_points(c("posts_per_day")),
        "forward_points": P.floating(
            comments_on, reactions_on, lambda _c, _r, f: P.forward_points(c("forward_rate"), c("members"), f)
        ),
        "comment_points": P.floating(
            comments_on, reactions_on, lambda m, _r, _f: P.comment_points(comments_on, c("avg_comments"), c("members"), m)
        ),
        "er_points": P.er_trend_points(c("er_status")),
        "reaction_points": P.floating(
            comments_on, reactions_on, lambda _c, r, _f: P.reaction_points(c("reaction_rate"), c("members"), r)
        ),
        "stability_points": P.stability_points(c("stability_cv"), c("stability_top")),
        "age_points": P.age_points(c("age_days")),
        "premium_points": F.when(c("complete"), P.premium_points(c("premium_ratio"), c("premium_count"))).otherwise(0),
        "source_points": P.source_points(c("source_share"), c("repost_ratio")),
    })
    return pointed.withColumns({
        "quality": c("cv_points") + c("reach_points") + c("regularity_points") + c("forward_points"),
        "engagement": c("comment_points") + c("er_points") + c("reaction_points") + c("stability_points"),
        "reputation": c("age_points") + c("premium_points") + c("source_points"),
        "quality_max": CATEGORY_MAX["quality"] + c("forwards_max") - 15,
        "engagement_max": CATEGORY_MAX["engagement"] + (c("comments_max") - 15) + (c("reactions_max") - 8),
        "reputation_max": F.lit(CATEGORY_MAX["reputation"]),
    }).withColumn("raw_score", clamp(c("quality") + c("engagement") + c("reputation"), 0, 100))


def add_trust(pointed: DataFrame) -> DataFrame:
    """Trust multipliers of the scan profile, their floored product and the flatness cap."""
    c = F.col
    multipliers = T.scan_multipliers()
    kept = F.filter(
        F.array(*[F.struct(T.detail_key(k, m).alias("key"), m.alias("multiplier")) for k, m in multipliers.items()]),
        lambda d: d["multiplier"] < 1.0,
    )
    hardcore = P.scoring_mode(c("accounts"))
    capped = (c("scoring_mode") == "hardcore") & F.coalesce(c("flatness_on"), F.lit(False))
    flatness = F.array(F.struct(F.lit("reaction_flatness").alias("key"), F.lit(0.8).alias("multiplier")))
    return pointed.withColumn("scoring_mode", hardcore).withColumns({
        "trust_details": F.when(capped, F.concat(kept, flatness)).otherwise(kept),
        "trust_product": F.greatest(F.lit(0.1), product(list(multipliers.values()))),
    }).withColumn("trust", F.when(capped, F.least(F.lit(0.8), c("trust_product"))).otherwise(c("trust_product")))


def add_llm_trust(rated: DataFrame) -> DataFrame:
    """Model-based multipliers; a channel without a model record stays neutral and uncapped."""
    llm = F.col("llm")
    known = llm.isNotNull()
    safety = T.safety_tier(llm["is_toxic"], llm["severity"], llm["toxic_category"], F.col("category"))
    return rated.withColumns({
        "ad_multiplier": T.ad_multiplier(llm["ad_percentage"]),
        "bot_multiplier": T.bot_multiplier(llm["bot_percentage"]),
        "safety_multiplier": safety["safety_multiplier"],
        "tier": F.when(known, safety["tier"]),
        "tier_cap": F.when(known, safety["tier_cap"]).otherwise(100),
        "exclusion_reason": safety["exclusion_reason"],
    }).withColumn(
        "llm_trust",
        F.when(known, T.llm_trust(F.col("ad_multiplier"), F.col("bot_multiplier"), F.col("safety_multiplier"))).otherwise(1.0),
    )


def add_score(rated: DataFrame) -> DataFrame:
    """Final score, verdict, combined trust and status, with the gates applied first."""
    c = F.col
    new = c("gate") == "insufficient_data"
    gated = rated.withColumn("gate", gate())
    conviction_used = c("gate").isNull() & c("conviction_scam")
    is_scam = ~F.coalesce(new, F.lit(False)) & (c("gate").isNotNull() | conviction_used | c("clustered"))
    base = c("raw_score") * c("trust") * c("llm_trust")
    return gated.withColumns({
        "scam_flag": is_scam,
        "score": F.when(new | (c("tier") == "EXCLUDED"), 0).otherwise(
            clamp(F.least(base, c("tier_cap").cast("double")).cast("int"), 0, 100)
        ),
    }).withColumns({
        "verdict": F.when(new, "NEW_CHANNEL").when(c("tier") == "EXCLUDED", "EXCLUDED").when(c("scam_flag"), "SCAM")
        .otherwise(verdict_of(c("score"))),
        "trust_factor": F.when(
            c("tier") == "EXCLUDED", half_even(c("trust"), 2)
        ).otherwise(half_even(F.greatest(F.lit(0.1), c("trust") * c("llm_trust")), 2)),
        "status": status_of(c("score")),
    })


def status_of(score: Column, good: int = GOOD_SCORE) -> Column:
    return F.when(score >= good, "GOOD").otherwise("BAD")


def convicted_channels(posts: DataFrame, channels: DataFrame, audience: DataFrame, as_of: Column) -> DataFrame:
    """Metrics, forensics and fraud factors of every channel.

    Fraud factors do not count where a gate already decided; the conviction seen by the
    trust product is 0 there.
    """
    rated = with_forensics(rated_metrics(posts, channels, as_of), audience)
    return add_conviction(rated).withColumn("gate", gate()).withColumn(
        "effective_conviction", F.when(F.col("gate").isNull(), F.col("effective_conviction")).otherwise(0)
    )


def score_channels(posts: DataFrame, channels: DataFrame, audience: DataFrame, as_of: Column) -> DataFrame:
    """Everything the engine knows about every channel, one row each. ``posts`` must carry text."""
    return add_score(add_llm_trust(add_trust(add_points(convicted_channels(posts, channels, audience, as_of)))))


def add_crawl_outcome(scored: DataFrame) -> DataFrame:
    """What is stored for a channel: toxic channels are bad with score 0, and a good one without label is retried."""
    critical = F.coalesce((F.col("llm.severity") == "CRITICAL") & F.col("llm.is_toxic"), F.lit(False))
    unlabelled = F.coalesce(F.col("category"), F.lit("")) == ""
    by_verdict = F.when(F.col("verdict") == "SCAM", "BAD").otherwise("GOOD")
    return scored.withColumns({
        "outcome_status": F.when(critical, "BAD").otherwise(by_verdict),
        "outcome_verdict": F.when(
            critical, F.concat(F.lit("TOXIC_"), F.coalesce("llm.toxic_category", F.lit("CONTENT")))
        ).otherwise(F.col("verdict")),
        "outcome_score": F.when(critical, 0).otherwise(F.col("score")),
        "retry": ~critical & (F.col("score") >= GOOD_SCORE) & unlabelled,
    })
