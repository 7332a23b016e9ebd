"""Compact per-channel records and their restoration, as whole-table jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlens.constants import SAMPLE_POSTS
from trustlens.functions.scalars import reactions_total
from trustlens.operators.channel_metrics import newest_posts

PAGE = 100


def compact_posts(posts: DataFrame, keep: int = SAMPLE_POSTS) -> DataFrame:
    """The newest posts of a channel as lists of id, epoch, views, forwards, reactions. An unknown date becomes 0."""
    numbers = F.array(
        F.coalesce("post_id", F.lit(0)), F.coalesce(F.unix_timestamp("ts"), F.lit(0)), F.coalesce("views", F.lit(0)),
        F.coalesce("forwards", F.lit(0)), reactions_total(F.col("reactions")),
    )
    sample = newest_posts(posts.select("channel_id", "post_id", "ts", numbers.alias("numbers")), keep)
    listed = F.sort_array(F.collect_list(F.struct("rn", "numbers")))
    return sample.groupBy("channel_id").agg(F.to_json(F.transform(listed, lambda p: p["numbers"])).alias("posts_raw"))


def restore_posts(compact: DataFrame) -> DataFrame:
    """Rows out of compact lists; lists that are too short are ignored."""
    lists = F.from_json("posts_raw", "ARRAY<ARRAY<BIGINT>>")
    rows = compact.select("channel_id", F.posexplode(F.filter(lists, lambda p: F.size(p) >= 5)).alias("place", "p"))
    p = F.col("p")
    return rows.select(
        "channel_id", "place", p[0].alias("post_id"), F.timestamp_seconds(p[1]).alias("ts"), p[2].alias("views"),
        p[3].alias("forwards"), p[4].alias("reactions"),
    )


def compact_accounts(audience: DataFrame, page: int = PAGE) -> DataFrame:
    """Account ids with the positions of the premium ones.

    A sampled channel fits one record. A larger one is spread over as many records as it
    needs, by a hash of the account, so that no record and no task holds a whole channel.
    """
    known = audience.where(F.col("user_id").isNotNull() & (F.col("user_id") != 0))
    pages = known.groupBy("channel_id").agg(F.ceil(F.count(F.lit(1)) / page).alias("pages"))
    paged = known.join(pages, "channel_id").withColumn("page", F.pmod(F.xxhash64("user_id"), F.col("pages")))
    listed = F.sort_array(F.collect_list(F.struct("user_id", F.coalesce("is_premium", F.lit(False)).alias("premium"))))
    grouped = paged.groupBy("channel_id", "page").agg(listed.alias("accounts"))
    places = F.transform("accounts", lambda a, i: F.when(a["premium"], i))
    record = F.struct(
        F.transform("accounts", lambda a: a["user_id"]).alias("i"),
        F.array_compact(places).alias("p"), F.lit(1).alias("_v"),
    )
    return grouped.select("channel_id", "page", F.to_json(record).alias("user_ids"))


def restore_accounts(compact: DataFrame) -> DataFrame:
    """Accounts out of compact records; positions beyond the list are ignored."""
    record = F.from_json("user_ids", "i ARRAY<BIGINT>, p ARRAY<INT>")
    rows = compact.select("channel_id", record.alias("r")).select(
        "channel_id", F.col("r.p").alias("places"), F.posexplode("r.i").alias("place", "user_id")
    )
    return rows.select("channel_id", "user_id", F.array_contains("places", F.col("place")).alias("is_premium"))
