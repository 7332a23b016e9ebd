"""Sinks and table maintenance: exports, request files, event appends, schema growth, row assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustlens.functions.scalars import half_even, normalise_name
from trustlens.operators.catalogue import category_filter
from trustlens.sources.schemas import SCAN_REQUESTS

EXPORTED = ["username", "score", "verdict", "members", "category", "category_secondary", "found_via", "scanned_at"]


def export_rows(results: DataFrame, status: str = "GOOD", category: str | None = None) -> DataFrame:
    kept = results.where(F.col("status") == status)
    if category:
        kept = kept.where(category_filter([category]))
    return kept.withColumns({
        "username": F.concat(F.lit("@"), "username"),
        "category": F.coalesce("category", F.lit("")), "category_secondary": F.coalesce("category_secondary", F.lit("")),
    }).select(*EXPORTED).orderBy(F.col("score").desc(), "username")


def export_csv(results: DataFrame, path: str, status: str = "GOOD", category: str | None = None) -> None:
    """CSV files with a header, best score first across the files."""
    export_rows(results, status, category).write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requested names; text that is no JSON counts as no request, and blank names are dropped."""
    return clean_requests(spark.read.schema(SCAN_REQUESTS).option("mode", "PERMISSIVE").json(path))


def clean_requests(requests: DataFrame) -> DataFrame:
    named = requests.withColumn("username", normalise_name(F.trim("username")))
    return named.where(F.coalesce(F.length("username"), F.lit(0)) > 0)


def append_events(events: DataFrame, path: str) -> None:
    """Append to the event table, split by day so that a period is read without the rest."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def grow_schema(rows: DataFrame, schema: T.StructType, defaults: dict[str, object]) -> DataFrame:
    """Rows with every declared column; columns that were missing are filled with their default."""
    missing = [f for f in schema.fields if f.name not in rows.columns]
    added = {f.name: F.lit(defaults.get(f.name)).cast(f.dataType) for f in missing}
    return rows.withColumns(added).select(*[f.name for f in schema.fields]) if added else rows.select(*schema.fieldNames())


def stored_row(scored: DataFrame, as_of: Column, links: DataFrame | None = None) -> DataFrame:
    """The wide row kept per scored channel; nested parts become structs or one JSON text."""
    def metric(value: str, points: str, digits: int) -> Column:
        return F.struct(half_even(F.col(value), digits).alias("value"), F.col(points).alias("points"))

    breakdown = F.struct(
        metric("cv_views", "cv_points", 2).alias("cv_views"), metric("reach", "reach_points", 2).alias("reach"),
        metric("posts_per_day", "regularity_points", 2).alias("regularity"), metric("forward_rate", "forward_points", 3).alias("forward_rate"),
        metric("reaction_rate", "reaction_points", 3).alias("reaction_rate"),
        F.struct(half_even(F.col("avg_comments"), 1).alias("avg"), F.col("comment_points").alias("points")).alias("comments"),
        F.struct(F.col("er_status").alias("status"), F.col("er_points").alias("points")).alias("er_trend"),
        F.struct(F.col("stability_cv").alias("value"), F.col("stability_top").alias("top_concentration"),
                 F.col("stability_points").alias("points")).alias("reaction_stability"),
        F.struct(F.col("age_days").alias("value"), F.col("age_points").alias("points")).alias("age"),
        F.struct(F.col("premium_ratio").alias("ratio"), F.col("premium_count").alias("count"), F.col("premium_points").alias("points")).alias("premium"),
        F.struct(half_even(1 - F.col("source_share"), 2).alias("value"), half_even(F.col("repost_ratio"), 2).alias("repost_ratio"),
                 F.col("source_points").alias("points")).alias("source_diversity"),
        F.struct(F.col("private_ratio").alias("private_ratio")).alias("private_links"),
    )
    categories = F.struct(*[
        F.struct(F.col(c).alias("score"), F.col(f"{c}_max").alias("max")).alias(c) for c in ("quality", "engagement", "reputation")
    ])
    forensic = F.struct(
        F.col("accounts").alias("users_analyzed"),
        F.struct(F.col("neighbour_ratio").alias("neighbor_ratio"), F.col("clustered").alias("fatality")).alias("id_clustering"),
        F.struct(F.col("foreign_ratio").alias("foreign_ratio")).alias("geo_dc_check"),
        F.struct(F.col("premium_ratio").alias("premium_ratio"), F.col("premium_count").alias("premium_count")).alias("premium_density"),
    )
    llm = F.struct("llm.ad_percentage", "llm.bot_percentage", F.col("llm_trust").alias("llm_trust_factor"), "tier", "tier_cap")
    rows = scored.select(
        "channel_id", "username", "status", "score", "verdict", "trust_factor", "members", "category", "category_secondary", "title", "description",
        "raw_score", F.col("scam_flag").alias("is_scam"), "tier", "trust_details", F.col("effective_conviction").alias("conviction_score"),
        F.transform(F.filter("factors", lambda f: f["triggered"]), lambda f: f["name"]).alias("conviction_factors"),
        "online_count", "participants_count", F.col("age_days").alias("channel_age_days"),
        half_even(safe_average(), 1).alias("avg_views"), half_even(F.col("reach"), 2).alias("reach_percent"),
        half_even(F.col("forward_rate"), 3).alias("forward_rate"), half_even(F.col("reaction_rate"), 3).alias("reaction_rate"),
        half_even(F.col("avg_comments"), 2).alias("avg_comments"), "comments_enabled", F.col("reactions_on").alias("reactions_enabled"),
        half_even(F.col("decay"), 2).alias("decay_ratio"), "er_status",
        F.to_json(F.struct(breakdown.alias("breakdown"), categories.alias("categories"), llm.alias("llm_analysis"))).alias("breakdown_json"),
        F.when(F.col("accounts") > 0, F.to_json(forensic)).alias("forensics_json"),
    )
    rows = rows.withColumns({"scanned_at": as_of, "found_via": F.lit(None).cast("string")})
    if links is None:
        return rows.withColumn("ad_links", F.array().cast("array<string>"))
    grouped = links.groupBy("username").agg(F.sort_array(F.collect_set("link")).alias("ad_links"))
    return rows.join(grouped, "username", "left").withColumn("ad_links", F.coalesce("ad_links", F.array().cast("array<string>")))


def safe_average() -> Column:
    return F.coalesce(F.col("total_views") / F.nullif(F.col("posts"), F.lit(0)), F.lit(0.0))
