"""Re-scoring, prices and presentation of stored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.queries import Query
from trustlens.functions import pricing as PR
from trustlens.functions import status as ST
from trustlens.plans import presentation as PS
from trustlens.plans import rescore as RS
from trustlens.plans.scoring import add_llm_trust
from trustlens.sources import stored_rows as R

QUERIES: dict[str, Query] = {}


def query(name: str):
    def add(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return add


def r4(name: str, alias: str | None = None):
    return F.round(name, 4).alias(alias or name)


INPUTS = ["clustered", "premium_count", "users_analyzed", "er_status", "scam_count", "bad_count", "ad_percentage", "bot_percentage"]
RATIOS = [
    "neighbour_ratio", "foreign_ratio", "reach", "forward_rate", "reaction_rate", "avg_comments", "conviction_score", "views_decay",
    "source_max_share", "posts_per_day", "private_ratio",
]


def inputs(source: str):
    def build(t):
        scope = R.import_rows(t.stored).where("has_metrics")
        return RS.trust_input(scope, source).select(
            "username", *INPUTS, *[F.round(F.col(c).cast("double"), 4).alias(c) for c in RATIOS]
        )

    return build


QUERIES["RSC-01"] = inputs("row")
QUERIES["RSC-01b"] = inputs("breakdown")


@query("RSC-02")
def _(t):
    return RS.stored_trust(R.import_rows(t.stored)).where("has_metrics").select("username", "stored_trust")


@query("RSC-03")
def _(t):
    return RS.stored_raw_score(R.import_rows(t.stored)).select(
        "username", "quality_points", "engagement_points", "reputation_points", "stored_raw")


@query("RSC-04")
def _(t):
    rated = RS.unified_trust(RS.trust_input(R.import_rows(t.stored).where("has_metrics"), "breakdown"))
    return rated.select("username", F.round("new_trust", 4).alias("new_trust"),
                        F.array_join(F.transform("penalties", lambda p: p["key"]), ",").alias("penalties"))


@query("RSC-05")
def _(t):
    return RS.rescore_diff(R.import_rows(t.stored)).select(
        "username", "new_raw", "new_score", F.round("new_trust", 4).alias("new_trust"), "new_verdict", "changed")


@query("RSC-06")
def _(t):
    return RS.rescore_all(R.import_rows(t.stored)).select("username", "new_score", "new_verdict", "new_status", "stored_trust")


@query("RSC-07")
def _(t):
    answers = add_llm_trust(t.channels)
    return RS.rescore_with_answers(R.import_rows(t.stored), answers).select("username", "new_score", "new_status", "new_tier")


@query("RSC-08")
def _(t):
    return RS.backfill_forensics(R.import_rows(t.stored), t.audience).select(
        "username", "users_analyzed", F.round("neighbour_ratio", 4).alias("neighbour_ratio"), F.round("new_trust", 4).alias("new_trust"))


@query("RSC-09")
def _(t):
    columns = [
        "in_cv_views", "in_reach", "in_posts_per_day", "in_forward_rate", "in_views_decay", "in_reaction_rate", "in_avg_comments",
        "in_stability_cv", "in_premium_ratio", "in_source_share", "in_repost_ratio",
    ]
    return RS.score_input(R.import_rows(t.stored)).select(
        "username", *[F.round(c, 4).alias(c) for c in columns], "in_er_status", "in_stability_points", "in_age", "in_premium_count",
        "in_comments_enabled", "in_reactions_enabled",
    )


@query("AGG-36")
def _(t):
    return RS.run_summary(R.import_rows(t.stored))


@query("JSN-03")
def _(t):
    m = F.col("m.comments")
    return R.import_rows(t.stored).select("username", F.round(R.stated_average(m["value"], m["avg"]), 2).alias("avg_comments"))


@query("JSN-04")
def _(t):
    return R.quick_stats(R.import_rows(t.stored)).select("username", "quick_reach", "quick_err", "quick_comments")


@query("PRC-01")
def _(t):
    rated = PR.with_rates(t.results)
    return rated.select("username", PR.cpm(F.col("score"), F.col("trust_factor"), F.col("cpm_low"), F.col("cpm_avg"), F.col("cpm_high")).alias("cpm"))


@query("PRC-02")
def _(t):
    return PS.detail_base(t.stored.withColumn("avg_views", F.lit(None).cast("bigint"))).select("username", "views_for_price")


@query("PRC-03")
def _(t):
    return PR.with_price(PS.detail_base(t.stored)).select(
        "username", "price_min", "price_max", "cpm", "cpm_low", "cpm_high", "views_for_price", "price_trust")


@query("PRC-04")
def _(t):
    return PR.with_rates(t.channels).select("channel_id", "cpm_low", "cpm_high")


@query("PRS-01")
def _(t):
    return PS.sorted_penalties(R.import_rows(t.stored)).select("username", F.posexplode("penalties").alias("place", "p")).select(
        "username", "place", F.col("p.name").alias("name"), F.round("p.multiplier", 2).alias("multiplier"))


@query("PRS-02")
def _(t):
    return PS.recommendations(PS.detail_base(t.stored)).select("username", F.posexplode("recommendations").alias("place", "code"))


@query("PRS-03")
def _(t):
    return PS.channel_details(t.stored).select(
        "username", "score", "verdict", "status", "members", "category", "price_min", "price_max", "quick_reach", "quick_err",
        "verified", "ad_status", F.size("penalties").alias("n_penalties"), F.size("recommendations").alias("n_recommendations"))


@query("PRS-04")
def _(t):
    from trustlens.operators.catalogue import catalogue_filter

    return PS.catalogue_rows(catalogue_filter(t.stored, 30)).select(
        "username", "title", "score", "verdict", "price_min", "price_max", "verified", "ad_status")


@query("PRS-05")
def _(t):
    return PS.llm_block(R.import_rows(t.stored))


@query("UIF-01")
def _(t):
    ad, pace, private, trust = F.col("llm.ad_percentage"), F.col("score") / 5, F.col("score") / 100, F.col("llm.comment_trust")
    columns = {
        "ad_status": ST.low_is_good(ad, 20, 40), "ad_load": ST.ad_load(ad), "trust_status": ST.high_is_good(trust, 60, 30),
        "brand_status": ST.brand_safety(trust), "activity_status": ST.activity(pace), "private_status": ST.private_share(private),
    }
    rows = t.results.withColumns(columns)
    return rows.select("username", *columns, ST.bar_percent(F.col("activity_status")).alias("activity_bar"))


@query("UIF-03")
def _(t):
    return PS.shown_breakdown(R.import_rows(t.stored)).select(
        "username", "category", "metric", "score", "max", F.round("value", 2).alias("value"), "disabled")


@query("UIF-03b")
def _(t):
    return PS.info_metrics(R.import_rows(t.stored)).select("username", "category", "metric", F.round("value", 2).alias("value"), "status", "bar_percent")


@query("UIF-04")
def _(t):
    return PS.estimated_breakdown(t.results)
