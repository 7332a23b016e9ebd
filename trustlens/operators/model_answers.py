"""Normalisation of stored model answers: free text to typed columns, set-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlens.constants import CATEGORIES
from trustlens.functions.mending import mended
from trustlens.functions.scalars import clamp, half_even

ANSWER = """
classification STRUCT<category: STRING, category_reasoning: STRING>,
safety STRUCT<status: STRING, is_scam: BOOLEAN, flags: ARRAY<STRING>>,
ad_analysis STRUCT<ad_post_ids: ARRAY<BIGINT>>,
audience STRUCT<trust_score: INT, verdict: STRING>,
ui_content STRUCT<summary_ru: STRING>,
meta_data STRUCT<contact_info: STRING, contact_type: STRING>,
toxicity INT, violence INT, military_conflict INT, political_quantity INT, political_risk INT, misinformation INT,
red_flags ARRAY<STRING>,
ad_percentage INT, ad_post_count INT, ad_count INT, total_comments INT, suspicious_bot_count INT, bot_percentage INT,
authenticity_tier STRING, trust_score INT, toxic_post_count INT, total_posts INT, toxic_category STRING, severity_label STRING
"""
NUMBERS = [
    "toxicity", "violence", "military_conflict", "political_quantity", "political_risk", "misinformation", "ad_percentage",
]
OBJECT = ["json", "repaired"]  # levels with a record


def _field(name: str) -> Column:
    found = F.regexp_extract("response", rf'(?i)"?{name}"?\s*[:\s]+(\d+)', 1)
    return F.nullif(found, F.lit("")).try_cast("int")


def answer_fields(responses: DataFrame) -> DataFrame:
    """Answers with a ``parsed`` record and the ``level`` it was found at.

    ``json``: the text from its first brace on starts with an object; what follows it is ignored. ``repaired``: that object is malformed and was mended.
    ``fields``: there is no brace, single fields are found in the text. ``failed`` and ``empty``: nothing is.
    """
    body = F.when(F.instr("response", "{") > 0, F.expr("substring(response, instr(response, '{'))"))
    strict = {"allowSingleQuotes": "false"}
    valid = F.from_json(body, "map<string,string>", strict).isNotNull()
    flags = F.regexp_extract("response", r'(?is)"?red_flags"?\s*:\s*\[(.*?)\]', 1)
    found = responses.withColumns({
        "answer object": F.when(body.isNotNull(), F.when(valid, body).otherwise(mended(body))),
        "flags_found": F.when(flags != "", F.regexp_extract_all(flags, F.lit('"([^"]+)"'), F.lit(1))),
    })
    level = (
        F.when(F.length(F.trim("response")) == 0, "empty").when(body.isNotNull(), F.when(valid, "json").otherwise("repaired"))
        .when(F.coalesce(*[_field(n) for n in NUMBERS]).isNotNull() | F.col("flags_found").isNotNull(), "fields").otherwise("failed")
    )
    return found.withColumns({"parsed": F.from_json("answer object", ANSWER), "level": level}).drop("answer object")


def flat_fields(answers: DataFrame) -> DataFrame:
    """The numeric fields from JSON or, failing that, from the text; missing ones are 0."""
    values = {
        n: F.coalesce(F.when(F.col("level").isin(OBJECT), F.col(f"parsed.{n}")), F.when(F.col("level") == "fields", _field(n)), F.lit(0))
        for n in NUMBERS
    }
    return answers.withColumns({
        **values,
        "red_flags": F.coalesce(F.col("parsed.red_flags"), F.when(F.col("level") == "fields", F.col("flags_found")),
                                F.array().cast("array<string>")),
    })


def _json_rows(answers: DataFrame) -> DataFrame:
    return answers.where(F.col("level").isin(OBJECT))


def ad_share(answers: DataFrame) -> DataFrame:
    """Percentage of ad posts, truncated and clamped to 0-100."""
    count = F.coalesce(F.nullif(F.col("parsed.ad_post_count"), F.lit(0)), F.col("parsed.ad_count"), F.lit(0))
    total = F.col("parsed.total_posts")
    share = F.when(total > 0, (count / F.nullif(total, F.lit(0)) * 100).cast("int")).otherwise(0)
    return _json_rows(answers).withColumn("ad_percentage", clamp(share, 0, 100))


def comment_authenticity(answers: DataFrame) -> DataFrame:
    """Bot percentage and trust score of the comments; explicit values win over counts and tiers."""
    p = "parsed."
    total, bots = F.coalesce(F.col(p + "total_comments"), F.lit(0)), F.coalesce(F.col(p + "suspicious_bot_count"), F.lit(0))
    counted = F.when(total > 0, (bots / F.nullif(total, F.lit(0)) * 100).cast("int")).otherwise(0)
    tier = F.coalesce(F.col(p + "authenticity_tier"), F.lit("MEDIUM"))
    by_tier = F.when(tier == "HIGH", 95).when(tier == "MEDIUM", 70).when(tier == "LOW", 30).otherwise(50)
    return _json_rows(answers).withColumns({
        "bot_percentage": F.coalesce(F.col(p + "bot_percentage"), counted),
        "trust_score": F.coalesce(F.col(p + "trust_score"), by_tier),
    })


def severity_confidence(severity: Column) -> Column:
    return (
        F.when(severity == "CRITICAL", 95).when(severity == "HIGH", 80).when(severity == "MEDIUM", 60).when(severity == "LOW", 40).otherwise(0)
    )


def toxicity(answers: DataFrame) -> DataFrame:
    """Toxic decision by severity and, for medium severity, by the share of toxic posts."""
    severity = F.coalesce(F.col("parsed.severity_label"), F.lit("SAFE"))
    category = F.nullif(F.col("parsed.toxic_category"), F.lit("null"))
    total = F.col("parsed.total_posts")
    ratio = F.when(total > 0, F.coalesce(F.col("parsed.toxic_post_count"), F.lit(0)) / F.nullif(total, F.lit(0))).otherwise(F.lit(0.0))
    toxic = category.isNotNull() & (severity.isin("CRITICAL", "HIGH") | ((severity == "MEDIUM") & (ratio > 0.10)))
    return _json_rows(answers).withColumns({
        "is_toxic": toxic,
        "toxic_category": F.when(toxic, category),
        "confidence": severity_confidence(severity),
        "toxic_ratio": half_even(ratio, 3),
        "severity": severity,
    })


def flag_category(flag: Column) -> Column:
    """Toxic category of a safety flag by keyword."""
    upper = F.upper(flag)

    def has(*words: str) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | upper.contains(word)
        return hit

    return (
        F.when(has("CASINO", "GAMBLING", "1WIN", "VAVADA"), "GAMBLING")
        .when(has("ADULT", "18+", "PORN", "NSFW"), "ADULT")
        .when(has("SCAM", "DARKNET", "DRUG", "FAKE"), "SCAM")
    )


def flat_record(answers: DataFrame, post_counts: DataFrame) -> DataFrame:
    """Nested answers to one flat record per row, defaults filled in; ``post_counts`` has key and posts, one row per key."""
    counted = post_counts.select("key", F.col("posts").alias("posts_of_key"))
    answers = answers.join(counted, "key", "left")
    p = F.col("parsed")
    category = p["classification"]["category"]
    status = F.coalesce(p["safety"]["status"], F.lit("SAFE"))
    flags = F.coalesce(p["safety"]["flags"], F.array().cast("array<string>"))
    trust = F.coalesce(p["audience"]["trust_score"], F.lit(70))
    verdict = F.coalesce(p["audience"]["verdict"], F.lit("MIXED"))
    ads = F.coalesce(F.size(p["ad_analysis"]["ad_post_ids"]), F.lit(0))
    toxic = status.isin("CRITICAL", "HIGH") | F.coalesce(p["safety"]["is_scam"], F.lit(False))
    return answers.withColumns({
        "category": F.when(category.isin(CATEGORIES), category).otherwise("LIFESTYLE"),
        "is_toxic": toxic,
        "toxic_severity": status,
        "toxic_category": flag_category(F.get(flags, F.lit(0))),
        "toxic_evidence": flags,
        "bot_percentage": F.greatest(F.lit(0), F.lit(100) - trust),
        "trust_score": trust,
        "authenticity_tier": F.when(verdict == "HIGH_QUALITY", "HIGH").when(verdict == "BOT_FARM", "LOW").otherwise("MEDIUM"),
        "ad_percentage": F.when((ads > 0) & (F.col("posts_of_key") > 0), (ads / F.col("posts_of_key") * 100).cast("int")).otherwise(0),
    }).drop("posts_of_key")
