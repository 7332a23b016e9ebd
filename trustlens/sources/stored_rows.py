"""Import of stored result rows: JSON texts in a long or a short format to one typed record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short keys and the metrics they stand for, with the maximum of each metric
SHORT_KEYS = {
    "cv": "cv_views", "re": "reach", "vd": "views_decay", "fr": "forward_rate", "co": "comments", "rr": "reaction_rate",
    "ev": "er_variation", "rs": "reaction_stability", "ve": "verified", "ag": "age", "pr": "premium", "sd": "source_diversity",
    "po": "posting_frequency", "pl": "private_links", "rg": "regularity", "er": "er_trend", "rf": "reaction_flatness",
}
MAXIMA = {
    "cv_views": 12, "reach": 8, "regularity": 7, "forward_rate": 15, "views_decay": 0, "comments": 15, "reaction_rate": 8,
    "er_trend": 10, "reaction_stability": 5, "verified": 0, "age": 7, "premium": 7, "source_diversity": 6,
}
SHORT_MARKERS = ["cv", "re", "vd", "fr", "co", "rr", "ev", "rs", "ve", "ag", "pr", "sd"]

_METRIC = "STRUCT<value: DOUBLE, points: INT, max: INT>"
_PRIVATE = "STRUCT<private_ratio: DOUBLE, private_posts: INT>"
_POSTING = "STRUCT<posts_per_day: DOUBLE, status: STRING>"
_TREND = "STRUCT<status: STRING, er_new: DOUBLE, er_old: DOUBLE, er_trend: DOUBLE, points: INT, max: INT>"
BREAKDOWN = f"""STRUCT<
  _v: INT, cv: ARRAY<DOUBLE>, re: ARRAY<DOUBLE>, vd: ARRAY<DOUBLE>, fr: ARRAY<DOUBLE>, co: ARRAY<STRING>, rr: ARRAY<DOUBLE>,
  ev: ARRAY<DOUBLE>, rs: ARRAY<DOUBLE>, ve: ARRAY<STRING>, ag: ARRAY<DOUBLE>, pr: STRING, sd: ARRAY<DOUBLE>, po: {_POSTING}, pl: {_PRIVATE},
  rg: ARRAY<DOUBLE>, er: {_TREND},
  cv_views: {_METRIC}, reach: {_METRIC}, regularity: {_METRIC}, views_decay: {_METRIC}, forward_rate: {_METRIC}, reaction_rate: {_METRIC},
  age: {_METRIC}, comments: STRUCT<value: STRING, points: INT, max: INT, avg: DOUBLE>, er_trend: {_TREND},
  reaction_stability: STRUCT<value: DOUBLE, points: INT, max: INT, top_concentration: DOUBLE>,
  verified: STRUCT<value: BOOLEAN, points: INT, max: INT>,
  premium: STRUCT<value: DOUBLE, points: INT, max: INT, ratio: DOUBLE, count: INT>,
  source_diversity: STRUCT<value: DOUBLE, points: INT, max: INT, repost_ratio: DOUBLE>,
  posting_frequency: {_POSTING}, private_links: {_PRIVATE}, comments_enabled: BOOLEAN, reactions_enabled: BOOLEAN,
  trust_details: MAP<STRING, STRUCT<multiplier: DOUBLE, score: DOUBLE, ratio: DOUBLE, scam_count: INT, bad_count: INT>>>"""
CATEGORY = "STRUCT<score: INT, max: INT>"
RECORD = f"""breakdown {BREAKDOWN}, categories STRUCT<quality: {CATEGORY}, engagement: {CATEGORY}, reputation: {CATEGORY}>,
  flags STRUCT<is_verified: BOOLEAN>,
  llm_analysis STRUCT<tier: STRING, tier_cap: INT, ad_percentage: INT, bot_percentage: INT, trust_score: INT, ad_mult: DOUBLE,
    bot_mult: DOUBLE, llm_trust_factor: DOUBLE>,
  conviction_details STRUCT<conviction_score: INT>"""
FORENSICS = """users_analyzed INT, id_clustering STRUCT<neighbor_ratio: DOUBLE, percentage: DOUBLE, fatality: BOOLEAN>,
  geo_dc_check STRUCT<foreign_ratio: DOUBLE, percentage: DOUBLE>, geo_dc_analysis STRUCT<foreign_ratio: DOUBLE, percentage: DOUBLE>,
  premium_density STRUCT<premium_ratio: DOUBLE, premium_count: INT, users_analyzed: INT>"""


def is_short(breakdown: Column) -> Column:
    """A version marker or any short key makes a record short."""
    keys = F.lit(False)
    for key in SHORT_MARKERS:
        keys = keys | breakdown[key].isNotNull()
    return breakdown["_v"].isNotNull() | keys


def _metric(b: Column, short: str, extra: dict[str, Column] | None = None) -> Column:
    """{value, points, max}, from the short list if there is one, else from the long record."""
    name = SHORT_KEYS[short]
    listed, long = b[short], b[name]
    pair = F.size(listed) == 2
    return F.when(pair | long.isNotNull(), F.struct(
        F.when(pair, listed[0]).otherwise(long["value"]).alias("value"),
        F.when(pair, listed[1].cast("int")).otherwise(long["points"]).alias("points"),
        F.when(pair, F.lit(MAXIMA[name])).otherwise(long["max"]).alias("max"),
        *[F.when(~F.coalesce(pair, F.lit(False)), column).alias(alias) for alias, column in (extra or {}).items()],
    ))


def metrics_record(b: Column) -> Column:
    """One typed record out of either format."""
    private_as_premium = F.get_json_object(b["pr"], "$.private_ratio").cast("double")
    first, second = (F.get_json_object(b["pr"], f"$[{i}]") for i in range(2))
    pair = second.isNotNull()
    return F.struct(
        _metric(b, "cv").alias("cv_views"), _metric(b, "re").alias("reach"), _metric(b, "rg").alias("regularity"),
        _metric(b, "vd").alias("views_decay"), _metric(b, "fr").alias("forward_rate"), _metric(b, "rr").alias("reaction_rate"),
        _metric(b, "ag").alias("age"),
        _metric(b, "rs", {"top": b["reaction_stability"]["top_concentration"]}).alias("stability"),
        _metric(b, "sd", {"repost_ratio": b["source_diversity"]["repost_ratio"]}).alias("source"),
        _metric(b, "co", {"avg": b["comments"]["avg"]}).alias("comments"),
        F.coalesce(F.get(b["ve"], F.lit(0)).cast("boolean"), b["verified"]["value"]).alias("verified"),
        F.when(pair | b["premium"].isNotNull(), F.struct(
            F.when(pair, first.cast("double")).otherwise(b["premium"]["value"]).alias("value"),
            F.when(pair, second.cast("int")).otherwise(b["premium"]["points"]).alias("points"),
            F.when(pair, F.lit(MAXIMA["premium"])).otherwise(b["premium"]["max"]).alias("max"),
            b["premium"]["ratio"].alias("ratio"), b["premium"]["count"].alias("count"),
        )).alias("premium"),
        F.coalesce(b["er"], b["er_trend"]).alias("er_trend"),
        F.coalesce(b["po"], b["posting_frequency"]).alias("posting"),
        F.coalesce(private_as_premium, b["pl"]["private_ratio"], b["private_links"]["private_ratio"]).alias("private_ratio"),
        F.coalesce(b["comments_enabled"], F.lit(True)).alias("comments_enabled"),
        F.coalesce(b["reactions_enabled"], F.lit(True)).alias("reactions_enabled"),
        b["trust_details"].alias("trust_details"),
    )


def import_rows(rows: DataFrame) -> DataFrame:
    """Rows with a typed record ``m``, ``categories``, ``llm_stored``, ``flags`` and ``forensic``.

    ``has_metrics`` tells whether anything was stored; without it all fields of ``m`` are
    missing or at their defaults. A projection only: each JSON text is parsed once per row,
    nothing is shuffled.
    """
    # a one-element explode keeps later filters on parsed values above the parse, which would otherwise run twice
    parsed = rows.select("*", F.inline(F.array(F.struct(F.from_json("breakdown_json", RECORD).alias("stored"))))).withColumn(
        "forensic", F.from_json("forensics_json", FORENSICS)
    )
    b = F.col("stored.breakdown")
    return parsed.withColumns({
        "has_metrics": b.isNotNull(),
        "has_answer": F.col("stored.llm_analysis").isNotNull(),
        "m": metrics_record(b),
        "short_format": F.when(b.isNotNull(), is_short(b)),
        "categories": F.col("stored.categories"),
        "flags": F.col("stored.flags"),
        "llm_stored": F.col("stored.llm_analysis"),
        "conviction_stored": F.col("stored.conviction_details.conviction_score"),
    }).drop("stored")


def patch_premium(imported: DataFrame) -> DataFrame:
    """Premium ratio and count of the forensics, where the row has both."""
    density = F.col("forensic.premium_density")
    premium = F.col("m.premium")
    patched = F.when(
        premium.isNotNull() & density.isNotNull(),
        premium.withField("ratio", F.coalesce(density["premium_ratio"], F.lit(0.0)))
        .withField("count", F.coalesce(density["premium_count"], F.lit(0))),
    ).otherwise(premium)
    return imported.withColumn("m", F.col("m").withField("premium", patched))


def stored_verified(breakdown_json: Column) -> Column:
    """Verified flag of a stored text; the flags win over the long metric record."""
    flag = F.get_json_object(breakdown_json, "$.flags.is_verified")
    value = F.get_json_object(breakdown_json, "$.breakdown.verified.value")
    return F.coalesce(flag.cast("boolean"), value.cast("boolean"), F.lit(False))


def stated_average(value: Column, average: Column) -> Column:
    """Mean comments from the numeric field, else from a text like ``enabled (avg 3.4)``."""
    text = F.nullif(F.regexp_extract(value, r"avg\s*([0-9.]+)", 1), F.lit(""))
    return F.coalesce(average, text.try_cast("double"), F.lit(0.0))


def quick_stats(imported: DataFrame) -> DataFrame:
    """Reach, engagement and mean comments as shown in lists."""
    shown = F.nullif(F.regexp_extract("m.comments.value", r"avg\s+([\d.]+)", 1), F.lit("")).try_cast("double")
    return imported.withColumns({
        "quick_reach": F.coalesce(F.bround("m.reach.value", 1), F.lit(0.0)),
        "quick_err": F.coalesce(F.bround("m.reaction_rate.value", 2), F.lit(0.0)),
        "quick_comments": F.coalesce(F.bround(shown, 1), F.lit(0.0)),
    })


def without_posts(results: DataFrame, posts: DataFrame) -> DataFrame:
    """Scored rows for which no post text is kept; only keys are compared."""
    kept = posts.where(F.length("text") > 0).select("channel_id").distinct()
    return results.where(F.col("status").isin("GOOD", "BAD")).join(kept, "channel_id", "left_anti")


def with_content(results: DataFrame, content: DataFrame) -> DataFrame:
    """Scanned rows for which a text is kept; only keys are compared."""
    return results.where(F.col("status") != "WAITING").join(content.select("channel_id").distinct(), "channel_id", "left_semi")


def without_forensics(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("forensics_json").isNull() & (F.col("status") != "WAITING") & F.col("scanned_at").isNotNull())
