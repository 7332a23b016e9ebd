"""Declared schemas of the input and result tables, and typed reads with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POSTS = """
channel_id BIGINT, post_id BIGINT, ts TIMESTAMP, text STRING, views BIGINT, forwards BIGINT, replies BIGINT,
reactions ARRAY<STRUCT<emoji: STRING, count: BIGINT>>,
forward_from STRUCT<id: BIGINT, type: STRING, username: STRING>,
media_type STRING,
entities ARRAY<STRUCT<type: STRING, offset: INT, length: INT, url: STRING>>,
buttons ARRAY<STRUCT<text: STRING, url: STRING>>
"""

RAW_MESSAGES = """
channel_id BIGINT, id BIGINT, date BIGINT, message STRING, views BIGINT, forwards BIGINT,
replies STRUCT<replies: BIGINT>,
reactions STRUCT<results: ARRAY<STRUCT<count: BIGINT, emoticon: STRING, document_id: BIGINT>>>,
fwd_from STRUCT<channel_id: BIGINT, chat_id: BIGINT, user_id: BIGINT>,
media STRING,
entities ARRAY<STRUCT<type: STRING, offset: INT, length: INT, url: STRING>>,
reply_markup ARRAY<ARRAY<STRUCT<text: STRING, url: STRING>>>
"""

AUDIENCE = """
channel_id BIGINT, user_id BIGINT, username STRING, is_premium BOOLEAN, is_scam BOOLEAN, is_fake BOOLEAN,
is_restricted BOOLEAN, is_deleted BOOLEAN, is_bot BOOLEAN, dc_id INT
"""

CHANNELS = """
channel_id BIGINT, username STRING, title STRING, description STRING, members BIGINT, participants_count BIGINT,
online_count BIGINT, created_at TIMESTAMP, is_scam BOOLEAN, is_fake BOOLEAN, is_verified BOOLEAN,
comments_enabled BOOLEAN, category STRING, category_secondary STRING,
llm STRUCT<ad_percentage: INT, bot_percentage: INT, comment_trust: INT, is_toxic: BOOLEAN, toxic_category: STRING, severity: STRING>
"""

COMMENTS = "channel_id BIGINT, comment_id BIGINT, user_id BIGINT, ts TIMESTAMP, text STRING"

USAGE_EVENTS = """
event_id BIGINT, ts TIMESTAMP, event_type STRING, user_id BIGINT, session_id STRING, username STRING, score INT,
verdict STRING, duration_ms BIGINT, status STRING, properties STRING, platform STRING
"""

SCAN_REQUESTS = "username STRING, requested_at TIMESTAMP"

RESULT_FEED = """
username STRING, status STRING, score INT, verdict STRING, trust_factor DOUBLE, members BIGINT, category STRING,
category_secondary STRING, ad_status INT, is_verified BOOLEAN, description STRING, scanned_at TIMESTAMP
"""

TABLES = {
    "posts": POSTS, "audience": AUDIENCE, "channels": CHANNELS, "comments": COMMENTS, "usage_events": USAGE_EVENTS,
    "scan_requests": SCAN_REQUESTS,
}


def read_table(spark: SparkSession, root: str, name: str, file_format: str = "parquet") -> DataFrame:
    """One input table with its declared schema; columns missing from the files come back as NULL."""
    return spark.read.schema(TABLES[name]).format(file_format).load(f"{root.rstrip('/')}/{name}")
