"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.queries import Query
from trustlens.operators import lifecycle as L
from trustlens.operators import text_corpus as T
from trustlens.operators import usage as U
from trustlens.plans.scoring import score_channels
from trustlens.session import scratch_dir
from trustlens.sources import bucketed
from trustlens.sources import compact as K
from trustlens.sources import raw_messages as W
from trustlens.sources import stored_rows as R
from trustlens.sources import tables as B
from trustlens.sources.samples import as_of

QUERIES: dict[str, Query] = {}


def query(name: str):
    def add(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return add


def raw_messages(t):
    """The events table in the shape of raw messages."""
    return t.raw("events").selectExpr(
        "user_id AS channel_id", "event_id AS id", "unix_timestamp(cast(ts AS timestamp)) AS date", "concat('message ', event_id) AS message",
        "CASE WHEN event_id % 9 <> 0 THEN floor(value * 10) END AS views", "event_id % 13 AS forwards",
        "CASE WHEN event_id % 4 <> 0 THEN named_struct('replies', event_id % 7) END AS replies",
        """CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 11 = 1 THEN named_struct('results', cast(array() AS array<struct<count:bigint,emoticon:string,document_id:bigint>>))
           ELSE named_struct('results', array(named_struct('count', event_id % 50, 'emoticon', '👍', 'document_id', cast(NULL AS bigint)),
             named_struct('count', event_id % 3, 'emoticon', cast(NULL AS string), 'document_id', event_id))) END AS reactions""",
        """CASE event_id % 6 WHEN 0 THEN named_struct('channel_id', event_id % 40, 'chat_id', cast(NULL AS bigint), 'user_id', cast(NULL AS bigint))
             WHEN 1 THEN named_struct('channel_id', cast(NULL AS bigint), 'chat_id', cast(NULL AS bigint), 'user_id', event_id % 90) END AS fwd_from""",
        "element_at(array('MessageMediaPhoto', 'MessageMediaDocument', 'MessageMediaVideo', 'MessageMediaGeo', NULL), int(event_id % 5) + 1) AS media",
        """CASE WHEN event_id % 3 = 0 THEN array(named_struct('type', 'url', 'offset', 0, 'length', 5, 'url', cast(NULL AS string)),
             named_struct('type', 'texturl', 'offset', 6, 'length', 4, 'url', concat('https://example.com/', event_id))) END AS entities""",
        """CASE WHEN event_id % 5 = 0 THEN array(array(named_struct('text', 'a', 'url', 'https://e.example/1'), named_struct('text', 'b', 'url', cast(NULL AS string))),
             array(named_struct('text', 'c', 'url', 'https://e.example/2'))) END AS reply_markup""",
    )


def posts_from_files(t):
    path = scratch_dir(t.spark, "raw-messages")
    raw_messages(t).write.json(path)
    return W.flatten_messages(W.read_messages(t.spark, path))


@query("SRC-01")
def _(t):
    return posts_from_files(t).select(
        "channel_id", "post_id", F.unix_timestamp("ts").alias("epoch"), "text", "views", "forwards", "replies",
        F.col("reactions").isNull().alias("reactions_off"),
        F.array_join(F.transform("reactions", lambda r: F.concat(r["emoji"], F.lit("="), r["count"].cast("string"))), ",").alias("reactions"),
        F.col("forward_from.id").alias("source_id"), F.col("forward_from.type").alias("source_type"),
    )


@query("SRC-02")
def _(t):
    return W.post_links(posts_from_files(t))


def raw_accounts(t):
    return t.audience.select(
        "channel_id", F.col("user_id").alias("id"), "username", F.nullif("is_scam", F.lit(False)).alias("scam"),
        F.col("is_fake").alias("fake"), F.col("is_restricted").alias("restricted"), F.col("is_deleted").alias("deleted"),
        F.col("is_bot").alias("bot"), F.nullif("is_premium", F.lit(False)).alias("premium"),
        F.when(F.col("dc_id").isNotNull(), F.struct("dc_id")).alias("photo"),
    )


@query("SRC-03")
def _(t):
    path = scratch_dir(t.spark, "raw-accounts")
    raw_accounts(t).write.json(path)
    return W.flatten_accounts(t.spark.read.schema(W.RAW_USERS).json(path)).select(
        "channel_id", "user_id", "is_premium", "is_scam", "is_fake", "is_restricted", "is_deleted", "is_bot", "dc_id")


@query("SRC-04")
def _(t):
    raw = t.channels.select(
        "channel_id", F.when(F.col("channel_id") % 3 != 0, F.col("online_count")).alias("online_count"), "participants_count",
        F.lit(None).cast("bigint").alias("admins_count"), F.lit(None).cast("bigint").alias("banned_count"),
        F.lit(None).cast("bigint").alias("kicked_count"), F.when(F.col("channel_id") % 2 == 0, "complete").alias("status"),
    )
    return W.health_counters(raw)


@query("SRC-05")
def _(t):
    return K.compact_posts(t.posts)


@query("SRC-05b")
def _(t):
    return K.restore_posts(K.compact_posts(t.posts)).select(
        "channel_id", "place", "post_id", F.unix_timestamp("ts").alias("epoch"), "views", "forwards", "reactions")


@query("SRC-06")
def _(t):
    return K.restore_accounts(K.compact_accounts(t.audience))


@query("SRC-07")
def _(t):
    return R.import_rows(t.stored).where("has_metrics").select(
        "username", "short_format", F.col("m.cv_views.value").alias("cv"), F.col("m.cv_views.max").alias("cv_max"),
        F.col("m.reach.points").alias("reach_points"), F.col("m.comments.points").alias("comment_points"), F.col("m.er_trend.status").alias("er_status"),
        F.col("m.stability.top").alias("stability_top"), F.col("m.premium.ratio").alias("premium_ratio"), F.col("m.private_ratio").alias("private_ratio"),
        F.col("m.verified").alias("verified"), F.col("m.source.value").alias("diversity"), F.col("m.posting.posts_per_day").alias("posts_per_day"),
    )


@query("SRC-09")
def _(t):
    return T.stored_content(t.posts_with_text, t.comments, t.audience).select("channel_id", "kind", "id", F.md5("text").alias("text_md5"), "is_premium", "user_id")


@query("SRC-10")
def _(t):
    path = scratch_dir(t.spark, "text-archive")
    T.text_archive(t.posts_with_text, t.comments).write.option("compression", "zstd").parquet(path)
    return t.spark.read.parquet(path).select("channel_id", "kind", "id", F.md5("text").alias("text_md5"))


@query("SRC-11")
def _(t):
    path = scratch_dir(t.spark, "export")
    B.export_csv(t.results.withColumn("scanned_at", F.unix_timestamp("scanned_at")), path, "GOOD", "NEWS")
    read = t.spark.read.option("header", True).csv(path)
    return read.select(*[F.coalesce(c, F.lit("")).alias(c) for c in B.EXPORTED])


@query("SRC-12")
def _(t):
    path = scratch_dir(t.spark, "results-json")
    B.export_json(t.results.select("username", "score", "verdict", "trust_factor", "ad_links", "llm"), path)
    schema = "username STRING, score INT, verdict STRING, trust_factor DOUBLE, ad_links ARRAY<STRING>, llm STRUCT<severity: STRING>"
    return t.spark.read.schema(schema).json(path).select(
        "username", "score", "verdict", "trust_factor", F.size("ad_links").alias("links"), F.col("llm.severity").alias("severity"))


@query("SRC-13")
def _(t):
    new = t.results.select("username", "score", "ad_status", "found_via").where("score >= 50")
    old = t.results.select("username", "score").where("score < 50")
    grown = B.grow_schema(old, new.schema, {"ad_status": 0, "found_via": "unknown"})
    return new.unionByName(grown)


@query("SRC-14")
def _(t):
    patch = t.results.where("channel_id % 3 = 0").select(
        "username", F.expr("score + 1").alias("score"), F.when(F.col("channel_id") % 2 == 0, F.lit("TECH")).alias("category"),
        F.concat(F.lit('{"a": '), "channel_id", F.lit("}")).alias("forensics"),
    )
    return L.patch_rows(t.results, patch, as_of()).select(
        "username", "score", "category", "forensics_json", "patched", F.unix_timestamp("scanned_at").alias("scanned_at"))


@query("SRC-15")
def _(t):
    path = scratch_dir(t.spark, "requests")
    lines = t.scan_requests.select(F.expr("""CASE WHEN request_id % 50 = 0 THEN 'not json'
        WHEN request_id % 30 = 0 THEN concat('{"username": "", "requested_at": "', date_format(requested_at, 'yyyy-MM-dd HH:mm:ss'), '"}')
        ELSE concat('{"username": "@', username, '", "requested_at": "', date_format(requested_at, 'yyyy-MM-dd HH:mm:ss'), '"}') END""").alias("value"))
    lines.write.text(path)
    return B.read_requests(t.spark, path).groupBy("username").agg(
        F.count(F.lit(1)).alias("requests"), F.unix_timestamp(F.min("requested_at")).alias("first_requested"))


@query("SRC-16")
def _(t):
    path = scratch_dir(t.spark, "usage-events")
    B.append_events(t.usage_events.where("event_id % 2 = 0"), path)
    B.append_events(t.usage_events.where("event_id % 2 = 1"), path)
    return U.event_summary(t.spark.read.parquet(path))


@query("SRC-17")
def _(t):
    scored = score_channels(t.posts_with_text, t.channels, t.audience, as_of())
    return B.stored_row(scored, as_of()).select(
        "username", "status", "score", "verdict", "trust_factor", "members", "raw_score", "is_scam", "conviction_score",
        F.array_join("conviction_factors", ",").alias("conviction_factors"), "channel_age_days", "avg_views", "reach_percent",
        F.get_json_object("breakdown_json", "$.breakdown.cv_views.points").cast("int").alias("cv_points"),
        F.get_json_object("breakdown_json", "$.categories.engagement.score").cast("int").alias("engagement"),
        F.get_json_object("breakdown_json", "$.llm_analysis.tier").alias("tier"), "er_status",
    )


@query("SRC-14b")
def _(t):
    """The partial update of SRC-14 on a stored table in buckets."""
    home = scratch_dir(t.spark, "bucketed")
    bucketed.store(t.results, home, "username", 16)
    patch = t.results.where("channel_id % 3 = 0").select(
        "username", F.expr("score + 1").alias("score"), F.when(F.col("channel_id") % 2 == 0, F.lit("TECH")).alias("category"),
        F.concat(F.lit('{"a": '), "channel_id", F.lit("}")).alias("forensics"),
    )
    return bucketed.merged(t.spark, home, lambda rows: L.patch_rows(rows, patch, as_of())).select(
        "username", "score", "category", "forensics_json", "patched", F.unix_timestamp("scanned_at").alias("scanned_at"))
