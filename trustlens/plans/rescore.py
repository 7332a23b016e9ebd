"""Bulk re-scoring of stored rows. Everything here is a projection: no shuffle, any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlens.functions import points as P
from trustlens.functions.scalars import half_even, product, verdict_of
from trustlens.operators import trust as T
from trustlens.operators.audience import forensics
from trustlens.plans.scoring import status_of
from trustlens.sources.stored_rows import patch_premium, stated_average


def _value(path: str, default) -> Column:
    return F.coalesce(F.col(path), F.lit(default))


def trust_input(imported: DataFrame, source: str = "row") -> DataFrame:
    """Inputs of the trust product from stored rows.

    ``row`` reads the row's own columns for percentages and activity, ``breakdown`` the stored
    analysis and penalties. The foreign share is accepted under both of its stored names.
    """
    def ratio(entry: Column, name: str) -> Column:
        percent = F.nullif(entry["percentage"], F.lit(0.0)) / 100
        return F.coalesce(percent, entry[name], F.lit(0.0))

    f, m = F.col("forensic"), F.col("m")
    details = m["trust_details"]
    geo = F.coalesce(f["geo_dc_analysis"], f["geo_dc_check"])
    diversity = m["source"]["value"]
    shared = {
        "neighbour_ratio": ratio(f["id_clustering"], "neighbor_ratio"),
        "clustered": F.coalesce(f["id_clustering"]["fatality"], F.lit(False)),
        "foreign_ratio": ratio(geo, "foreign_ratio"),
        "premium_count": _value("forensic.premium_density.premium_count", 0),
        "reach": _value("m.reach.value", 0.0), "forward_rate": _value("m.forward_rate.value", 0.0),
        "reaction_rate": _value("m.reaction_rate.value", 0.0),
        "er_status": F.coalesce(m["er_trend"]["status"], F.lit("insufficient_data")),
        "avg_comments": stated_average(m["comments"]["value"], m["comments"]["avg"]),
    }
    if source == "row":
        own = {
            "users_analyzed": F.coalesce(
                F.nullif(f["users_analyzed"], F.lit(0)), f["premium_density"]["users_analyzed"], F.lit(0)),
            "conviction_score": F.coalesce(F.col("conviction_stored"), F.lit(0)),
            "views_decay": F.coalesce(F.nullif(m["views_decay"]["value"], F.lit(0.0)), F.lit(1.0)),
            "source_max_share": 1 - F.coalesce(F.nullif(diversity, F.lit(0.0)), F.lit(1.0)),
            "posts_per_day": F.coalesce(m["regularity"]["value"], F.lit(0.0)),
            "private_ratio": F.coalesce(m["private_ratio"], F.lit(0.0)),
            "scam_count": F.lit(0), "bad_count": F.lit(0),
        }
    else:
        network = F.try_element_at(details, F.lit("scam_network"))
        private = F.element_at(F.filter(F.map_entries(details), lambda e: F.lower(e["key"]).contains("private")), 1)
        own = {
            "users_analyzed": F.coalesce(f["users_analyzed"], f["premium_density"]["users_analyzed"], F.lit(0)),
            "conviction_score": F.coalesce(F.try_element_at(details, F.lit("conviction"))["score"], F.lit(0.0)),
            "views_decay": F.coalesce(m["views_decay"]["value"], F.lit(1.0)),
            "source_max_share": F.when(F.coalesce(diversity, F.lit(0.0)) != 0, 1 - diversity).otherwise(F.lit(0.0)),
            "posts_per_day": F.coalesce(m["regularity"]["value"], F.lit(0.0)),
            "private_ratio": F.when(
                F.exists(F.map_keys(details), lambda k: F.lower(k).contains("private")), F.coalesce(private["value"]["ratio"], F.lit(0.0))
            ).otherwise(F.lit(0.0)),
            "scam_count": F.coalesce(network["scam_count"], F.lit(0)), "bad_count": F.coalesce(network["bad_count"], F.lit(0)),
            "ad_percentage": F.coalesce(F.col("llm_stored.ad_percentage"), F.lit(0)),
            "bot_percentage": F.coalesce(F.col("llm_stored.bot_percentage"), F.lit(0)),
            "comments_enabled": F.coalesce(m["comments_enabled"], F.lit(True)),
        }
    return imported.withColumns({**shared, **own})


def unified_trust(inputs: DataFrame) -> DataFrame:
    """Re-score trust with the list of its penalties; an id farm takes it to 0, otherwise it is at least .1."""
    multipliers = T.rescore_multipliers()
    listed = F.filter(
        F.array(*[F.struct(T.detail_key(k, v).alias("key"), v.alias("multiplier")) for k, v in multipliers.items()]),
        lambda p: p["multiplier"] < 1.0,
    )
    total = product(list(multipliers.values()))
    trust = (
        F.when(multipliers["id_clustering"] == 0.0, F.lit(0.0)).when(F.size("penalties") == 0, F.lit(1.0))
        .otherwise(F.greatest(F.lit(0.1), half_even(total, 2)))
    )
    return inputs.withColumn("penalties", listed).withColumn("new_trust", trust)


def stored_trust(imported: DataFrame) -> DataFrame:
    """Trust from the multipliers that were stored with the row, in their stored order."""
    kept = F.filter(F.map_values(F.col("m.trust_details")), lambda d: d["multiplier"] < 1.0)
    factors = F.transform(F.coalesce(kept, F.array().cast(kept_type())), lambda d: d["multiplier"])
    llm = F.col("llm_stored.llm_trust_factor")
    extended = F.when((llm < 1.0) & (llm != 0.0), F.array_append(factors, llm)).otherwise(factors)
    total = F.aggregate(extended, F.lit(1.0), lambda acc, f: acc * f)
    return imported.withColumn("stored_trust", F.greatest(F.lit(0.1), half_even(total, 2)))


def kept_type() -> str:
    return "array<struct<multiplier:double,score:double,ratio:double,scam_count:int,bad_count:int>>"


def stored_raw_score(imported: DataFrame) -> DataFrame:
    """Raw score from stored metric values; comment points are reused as stored."""
    comments_on = _value("m.comments_enabled", True)
    reactions_on = _value("m.reactions_enabled", True)
    members = F.coalesce("members", F.lit(0))
    forward, reach, rate = _value("m.forward_rate.value", 0.0), _value("m.reach.value", 0.0), _value("m.reaction_rate.value", 0.0)
    source = F.col("m.source")
    parts = {
        "quality_points": P.cv_points(_value("m.cv_views.value", 0.0), forward) + P.reach_points(reach, members)
        + P.floating(comments_on, reactions_on, lambda _c, _r, top: P.forward_points(forward, members, top))
        + P.regularity_points(F.coalesce("m.regularity.value", "m.posting.posts_per_day", F.lit(0.0))),
        "engagement_points": _value("m.comments.points", 0)
        + F.when(reactions_on, P.floating(comments_on, reactions_on, lambda _c, top, _f: P.reaction_points(rate, members, top))).otherwise(0)
        + P.stability_points(_value("m.stability.value", 50.0), _value("m.stability.top", 0.2), zero_is_missing=False)
        + P.er_trend_points(F.coalesce(F.col("m.er_trend.status"), F.lit("insufficient_data"))),
        "reputation_points": P.age_points(_value("m.age.value", 0.0).cast("int"))
        + P.premium_points(_value("m.premium.ratio", 0.0), _value("m.premium.count", 0))
        + P.source_points(1 - F.coalesce(source["value"], F.lit(0.0)), F.coalesce(source["repost_ratio"], F.lit(0.0))),
    }
    known = F.col("has_metrics")
    scored = imported.withColumns({name: F.when(known, column).otherwise(0) for name, column in parts.items()})
    return scored.withColumn(
        "stored_raw", F.least(F.lit(100), F.col("quality_points") + F.col("engagement_points") + F.col("reputation_points"))
    )


def rescore_diff(imported: DataFrame) -> DataFrame:
    """Old and new score, trust and verdict of every row, and whether anything changed."""
    rated = stored_raw_score(unified_trust(trust_input(imported, "row")))
    known = F.col("has_metrics")
    new_score = half_even(F.col("stored_raw") * F.col("new_trust"), 0).cast("int")
    rated = rated.withColumns({
        "new_raw": F.when(known, F.col("stored_raw")).otherwise(0),
        "new_score": F.when(known, new_score).otherwise(F.col("score")),
        "new_trust": F.when(known, F.col("new_trust")).otherwise(F.col("trust_factor")),
    }).withColumn("new_verdict", F.when(known, verdict_of(F.col("new_score"))).otherwise(F.col("verdict")))
    changed = (
        (F.col("score") != F.col("new_score")) | (F.abs(F.col("trust_factor") - F.col("new_trust")) > 0.01)
        | (F.col("verdict") != F.col("new_verdict"))
    )
    return rated.withColumn("changed", known & changed)


def rescore_all(imported: DataFrame) -> DataFrame:
    """New score, verdict, status and trust of all scored rows that have stored metrics."""
    scope = imported.where(F.col("status").isin("GOOD", "BAD") & F.col("has_metrics"))
    rated = stored_raw_score(patch_premium(stored_trust(scope)))
    return rated.withColumn("new_score", (F.col("stored_raw") * F.col("stored_trust")).cast("int")).withColumns({
        "new_verdict": verdict_of(F.col("new_score")), "new_status": status_of(F.col("new_score")),
    })


def rescore_with_answers(imported: DataFrame, answers: DataFrame, bonus: float = 5.0) -> DataFrame:
    """Scores with fresh model records: bonus added, both trusts applied, capped by the tier."""
    scope = imported.where(F.col("status").isin("GOOD", "BAD"))
    joined = stored_raw_score(scope).join(
        answers.select("channel_id", "llm_trust", F.col("tier").alias("new_tier"), F.col("tier_cap").alias("new_cap")), "channel_id"
    )
    old_trust = F.coalesce(F.nullif("trust_factor", F.lit(0.0)), F.lit(1.0))
    score = ((F.col("stored_raw") + bonus) * old_trust * F.col("llm_trust")).cast("int")
    return joined.withColumn("new_score", F.least(score, F.col("new_cap"))).withColumn("new_status", status_of(F.col("new_score")))


def backfill_forensics(imported: DataFrame, audience: DataFrame) -> DataFrame:
    """Forensics and trust for scanned rows that lack them, from the accounts at hand; too few accounts are skipped."""
    missing = imported.where(F.col("forensics_json").isNull() & (F.col("status") != "WAITING"))
    wanted = audience.join(missing.select("channel_id"), "channel_id", "left_semi")
    found = forensics(wanted).where("complete").select(
        "channel_id", "accounts", F.col("neighbour_ratio").alias("_neighbours"), F.col("clustered").alias("_clustered"),
        F.col("foreign_ratio").alias("_foreign"), F.col("premium_count").alias("_premium"),
    )
    inputs = trust_input(missing, "breakdown").join(found, "channel_id").withColumns({
        "neighbour_ratio": F.col("_neighbours"), "clustered": F.col("_clustered"), "foreign_ratio": F.col("_foreign"),
        "premium_count": F.col("_premium"), "users_analyzed": F.col("accounts"),
        "ad_percentage": F.lit(0), "bot_percentage": F.lit(0),
    })
    return unified_trust(inputs)


def score_input(imported: DataFrame) -> DataFrame:
    """Inputs of the raw score with the defaults of missing values."""
    m = F.col("m")
    return imported.withColumns({
        "in_cv_views": _value("m.cv_views.value", 0.0), "in_reach": _value("m.reach.value", 0.0),
        "in_posts_per_day": _value("m.regularity.value", 0.0), "in_forward_rate": _value("m.forward_rate.value", 0.0),
        "in_views_decay": _value("m.views_decay.value", 1.0), "in_reaction_rate": _value("m.reaction_rate.value", 0.0),
        "in_avg_comments": stated_average(m["comments"]["value"], m["comments"]["avg"]),
        "in_er_status": F.coalesce(m["er_trend"]["status"], F.lit("critical_decline")),
        "in_stability_cv": _value("m.stability.value", 100.0), "in_stability_points": _value("m.stability.points", 0),
        "in_age": _value("m.age.value", 0.0).cast("int"), "in_premium_ratio": _value("m.premium.ratio", 0.0),
        "in_premium_count": _value("m.premium.count", 0), "in_source_share": 1 - _value("m.source.value", 0.0),
        "in_repost_ratio": _value("m.source.repost_ratio", 1.0),
        "in_comments_enabled": _value("m.comments_enabled", True), "in_reactions_enabled": _value("m.reactions_enabled", True),
    })


def run_summary(imported: DataFrame) -> DataFrame:
    """Totals of a bulk run: rows in scope, updated, skipped, unreadable, changed."""
    scope = imported.where(F.col("status").isin("GOOD", "BAD") & F.col("breakdown_json").isNotNull())
    rated = stored_raw_score(patch_premium(stored_trust(scope)))
    updated = F.col("has_metrics")
    new_score = (F.col("stored_raw") * F.col("stored_trust")).cast("int")
    readable = F.get_json_object("breakdown_json", "$").isNotNull()
    return rated.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(updated).alias("updated"), F.count_if(~updated & readable).alias("skipped"),
        F.count_if(~readable).alias("errors"), F.count_if(updated & (F.col("score") != new_score)).alias("changed"),
    )
