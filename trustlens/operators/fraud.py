"""Fraud factors, gates and the conviction total, over one row per channel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlens.constants import MIN_MEMBERS, MIN_POSTS
from trustlens.functions.scalars import by_size, safe_ratio


@dataclass(frozen=True)
class Factor:
    """A fraud signal: its weight is 0 unless it is triggered."""

    name: str
    weight: Column
    triggered: Column
    value: Column
    threshold: Column


def has_alibi() -> Column:
    """Viral forwards, or a lively and trusted discussion, explain an extreme reach."""
    lively = F.col("avg_comments") > by_size(F.col("members"), 0.5, 1.0, 2.0, 5.0)
    return (F.col("forward_rate") > 3.0) | (lively & (F.col("comment_trust") >= 70))


def _number(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("double")


def _two_level(name: str, strong: Column, strong_weight, weak: Column, weak_weight, value: Column, threshold) -> Factor:
    weight = F.when(strong, strong_weight).when(weak, weak_weight).otherwise(0)
    return Factor(name, weight, weight > 0, _number(value), _number(threshold))


def _one_level(name: str, condition: Column, points: int, value: Column, threshold) -> Factor:
    condition = F.coalesce(condition, F.lit(False))
    return Factor(name, F.when(condition, points).otherwise(0), condition, _number(value), _number(threshold))


def velocity() -> Column:
    return F.col("members") / F.col("age_days")


def fraud_factors() -> dict[str, Factor]:
    """The thirteen factors in their fixed order, keyed by name."""
    c = F.col
    members, reach, decay = c("members"), c("reach"), c("decay")
    limit = by_size(members, 250, 180, 150, 130)
    accused = ~has_alibi()
    over = accused & (reach > limit)
    per_post, comments = c("reactions_per_post"), c("avg_comments")
    comment_share = F.when(per_post > 0, comments / F.nullif(per_post, F.lit(0.0))).otherwise(F.lit(1.0))
    young = c("age_days") < 90
    speed = velocity()
    warn, fake = by_size(members, 30, 50, 150, 300), by_size(members, 100, 200, 500, 1000)
    expected = by_size(members, 0.80, 0.50, 0.30, 0.15)
    effective = F.when(c("avg_views") > 0, c("avg_views") / expected / members).otherwise(F.lit(1.0))
    cv_known = c("viewed_posts") >= 5
    flat_share = safe_ratio(c("flat_posts"), c("rankable_posts"))
    listed = [
        Factor("impossible_reach", F.when(accused & (reach > 300), 35).when(over, 30).otherwise(0), over,
               _number(reach), _number(limit)),
        _two_level("flat_cv", cv_known & (c("cv_views") < 10), 25, cv_known & (c("cv_views") < 15), 20, c("cv_views"), 15),
        _one_level("dead_engagement",
                   c("comments_enabled") & (((per_post > 50) & (comment_share < 0.02)) | ((per_post > 100) & (comments < 1))),
                   20, comment_share, 0.02),
        _two_level("no_decay", c("decay_known") & (decay < 0.7), 15, c("decay_known") & (decay < 0.85), 10, decay, 0.85),
        _one_level("simple_reactions",
                   (c("total_reactions") > 0) & (c("simple_share") > 0.95) & (c("emoji_types") <= 2), 10, c("simple_share"), 0.95),
        _one_level("disabled_comments", ~c("comments_enabled"), 15, c("comments_enabled").cast("int"), 1),
        _one_level("bot_regularity", (c("posts") >= 10) & (c("gaps") >= 5) & (c("interval_cv") < 0.15), 10, c("interval_cv"), 0.15),
        _one_level("flat_reactions", (c("rankable_posts") >= 3) & (flat_share > 0.5), 20, flat_share, 0.5),
        _one_level("extreme_reach_decay", c("decay_known") & (reach > 200) & (decay < 0.7), 25, reach, 200),
        _one_level("high_reactions_low_comments", c("comments_enabled") & (per_post > 500) & (comments < 5), 15, per_post, 500),
        Factor("suspicious_velocity",
               F.when(speed > fake, F.when(young, 25).otherwise(20)).when(speed > warn, F.when(young, 10).otherwise(5)).otherwise(0),
               speed > warn, _number(speed), _number(fake)),
        _two_level("effective_members", effective < 0.30, 25, effective < 0.50, 10, effective, 0.30),
        _one_level("young_fast_inactive",
                   (c("age_days") < 60) & (speed > 100) & ((c("reaction_rate") < 1.0) | (comments < 0.5)), 30, speed, 100),
    ]
    return {factor.name: factor for factor in listed}


def mitigation() -> Column:
    viral = F.when(F.col("forward_rate") / 100 > 0.05, 15).otherwise(0)
    return viral + F.when(F.col("is_verified"), 20).otherwise(0)


def add_conviction(channels: DataFrame) -> DataFrame:
    """Factor array, conviction totals and the scam decision of the factors."""
    factors = F.array(*[
        F.struct(F.lit(f.name).alias("name"), f.weight.cast("int").alias("weight"), f.triggered.alias("triggered"),
                 f.value.alias("value"), f.threshold.alias("threshold"))
        for f in fraud_factors().values()
    ])
    listed = F.col("factors")
    rated = channels.withColumn("factors", factors).withColumns({
        "conviction": F.aggregate(listed, F.lit(0), lambda total, f: total + f["weight"]),
        "factors_triggered": F.aggregate(listed, F.lit(0), lambda total, f: total + f["triggered"].cast("int")),
        "mitigation": mitigation(),
    }).withColumn("effective_conviction", F.greatest(F.lit(0), F.col("conviction") - F.col("mitigation")))
    effective, hit = F.col("effective_conviction"), F.col("factors_triggered")
    return rated.withColumn(
        "conviction_scam",
        ((effective >= 50) & (hit >= 2)) | ((effective >= 70) & (hit >= 1)) | (F.col("conviction") >= 80),
    )


def gate() -> Column:
    """The first gate that stops a channel, or NULL when the factors decide."""
    c = F.col
    shown = F.coalesce(F.nullif(c("participants_count"), F.lit(0)), F.nullif(c("members_known"), F.lit(0)), F.lit(0))
    return (
        F.when((c("posts") < MIN_POSTS) | (shown < MIN_MEMBERS), "insufficient_data")
        .when(c("is_scam"), "flagged_scam").when(c("is_fake"), "flagged_fake")
        .when(c("viewed_posts") == 0, "no_views").when(c("impossible"), "impossible_counts")
    )
