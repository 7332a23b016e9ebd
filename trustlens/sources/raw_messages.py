"""Typed scans of raw channel samples: messages, accounts, health counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.sources.schemas import RAW_MESSAGES

RAW_USERS = """
channel_id BIGINT, id BIGINT, username STRING, scam BOOLEAN, fake BOOLEAN, restricted BOOLEAN, deleted BOOLEAN, bot BOOLEAN,
premium BOOLEAN, photo STRUCT<dc_id: INT>
"""
HEALTH = "channel_id BIGINT, online_count BIGINT, participants_count BIGINT, admins_count BIGINT, banned_count BIGINT, kicked_count BIGINT, status STRING"

# Media types in the order in which a class name is tested for them
MEDIA = ["photo", "video", "document", "audio", "voice", "sticker"]


def parsed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its message; a line of which any field does not fit the schema is kept as ``rejected``.

    All fields are parsed whichever are selected later, so what is rejected does not depend on the query.
    """
    schema = f"{RAW_MESSAGES}, rejected STRING"
    message = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "rejected"})
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select("value", message.alias("message"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Raw message files with a declared schema; see ``rejected_messages`` for the lines that do not fit it."""
    good = parsed_lines(spark, path).where(F.col("message.rejected").isNull())
    return good.select("message.*").drop("rejected")


def rejected_messages(spark: SparkSession, path: str) -> DataFrame:
    """The lines that ``read_messages`` leaves out; their count says how many."""
    return parsed_lines(spark, path).where(F.col("message.rejected").isNotNull()).select(F.col("value").alias("line"))


def media_type(media: Column) -> Column:
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in MEDIA:
        found = found.when(media.contains(name.capitalize()), name)
    return found


def reaction_emoji(reaction: Column) -> Column:
    custom = F.concat(F.lit("custom_"), reaction["document_id"].cast("string"))
    return F.coalesce(reaction["emoticon"], custom, F.lit("?"))


def flatten_messages(raw: DataFrame) -> DataFrame:
    """Raw messages to the posts schema. A missing reactions object stays NULL, an empty one becomes an empty array."""
    forward = F.col("fwd_from")
    source = F.coalesce(forward["channel_id"], forward["chat_id"], forward["user_id"])
    kind = F.when(forward["channel_id"].isNull() & forward["chat_id"].isNull() & forward["user_id"].isNotNull(), "user").otherwise("channel")
    results = F.coalesce("reactions.results", F.array().cast("array<struct<count:bigint,emoticon:string,document_id:bigint>>"))
    return raw.select(
        "channel_id", F.col("id").alias("post_id"), F.timestamp_seconds("date").alias("ts"),
        F.coalesce("message", F.lit("")).alias("text"),
        F.coalesce("views", F.lit(0)).alias("views"), F.coalesce("forwards", F.lit(0)).alias("forwards"),
        F.coalesce("replies.replies", F.lit(0)).alias("replies"),
        F.when(F.col("reactions").isNotNull(), F.transform(
            results, lambda r: F.struct(reaction_emoji(r).alias("emoji"), F.coalesce(r["count"], F.lit(0)).alias("count"))
        )).alias("reactions"),
        F.when(source.isNotNull(), F.struct(source.alias("id"), kind.alias("type"), F.lit(None).cast("string").alias("username"))).alias("forward_from"),
        media_type(F.col("media")).alias("media_type"),
        F.coalesce("entities", F.array().cast("array<struct<type:string,offset:int,length:int,url:string>>")).alias("entities"),
        F.filter(
            F.flatten(F.coalesce("reply_markup", F.array().cast("array<array<struct<text:string,url:string>>>"))),
            lambda b: b["url"].isNotNull() & (b["url"] != ""),
        ).alias("buttons"),
    )


def post_links(posts: DataFrame) -> DataFrame:
    """Long table of the urls in entities and buttons; posts without any keep one row."""
    urls = F.concat(
        F.transform(F.filter("entities", lambda e: e["url"].isNotNull()), lambda e: F.struct(e["type"].alias("kind"), e["url"].alias("url"))),
        F.transform("buttons", lambda b: F.struct(F.lit("button").alias("kind"), b["url"].alias("url"))),
    )
    return posts.select("post_id", "media_type", F.explode_outer(urls).alias("link")).select(
        "post_id", "media_type", "link.kind", "link.url"
    )


def flatten_accounts(raw: DataFrame) -> DataFrame:
    """Raw accounts to the audience schema; the data centre is only known where there is a photo."""
    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)).alias(f"is_{name}")

    return raw.select(
        "channel_id", F.col("id").alias("user_id"), "username", flag("premium"), flag("scam"), flag("fake"), flag("restricted"),
        flag("deleted"), flag("bot"), F.col("photo.dc_id").alias("dc_id"),
    )


def health_counters(raw: DataFrame) -> DataFrame:
    counters = ["online_count", "participants_count", "admins_count", "banned_count", "kicked_count"]
    return raw.select("channel_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counters], F.coalesce("status", F.lit("unknown")).alias("status"))
