"""Audience forensics: id clustering, data-centre, premium and flag statistics.

A channel may own a large part of all accounts, so no step orders or collects the
accounts of one channel in one task. The neighbour count works on id cells: with cells
one wider than the largest gap that counts, all consecutive ids of a cell are
neighbours, and the pair that spans two cells is decided from the cells' extreme ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlens.constants import FOREIGN_DC, MIN_ACCOUNTS, NATIVE_DC, NEIGHBOUR_GAP
from trustlens.functions.scalars import half_even, safe_ratio

FACTS = ["dc_id", "is_premium", "is_scam", "is_fake", "is_restricted", "is_deleted", "is_bot"]


def neighbour_pairs(audience: DataFrame, gap: int = NEIGHBOUR_GAP) -> DataFrame:
    """Per channel: ids and consecutive pairs (in id order) no further apart than ``gap``.

    Exact and free of per-channel sorting: both shuffles are keyed by (channel, cell) and
    pre-aggregate before they travel.
    """
    width = gap + 1
    ids = audience.where(F.col("user_id").isNotNull() & (F.col("user_id") != 0))
    cells = ids.groupBy("channel_id", F.floor(F.col("user_id") / width).alias("cell")).agg(
        F.count(F.lit(1)).alias("ids"), F.min("user_id").alias("low"), F.max("user_id").alias("high")
    )
    # each cell also announces its largest id to the next cell
    both = cells.select(
        "channel_id",
        F.inline(F.array(
            F.struct(F.col("cell"), F.col("ids"), F.col("low"), F.lit(None).cast("bigint").alias("before")),
            F.struct((F.col("cell") + 1).alias("cell"), F.lit(0).cast("bigint").alias("ids"),
                     F.lit(None).cast("bigint").alias("low"), F.col("high").alias("before")),
        )),
    )
    joined = both.groupBy("channel_id", "cell").agg(
        F.sum("ids").alias("ids"), F.max("low").alias("low"), F.max("before").alias("before")
    )
    inside = F.greatest(F.col("ids") - 1, F.lit(0))
    across = F.when(F.col("low") - F.col("before") <= gap, 1).otherwise(0)
    return joined.groupBy("channel_id").agg(
        F.sum("ids").alias("ids"), F.sum(inside + across).alias("neighbour_pairs")
    )


def account_counts(audience: DataFrame) -> DataFrame:
    """Counts per channel in one pass with map-side partial aggregation."""
    def flag(name: str):
        return F.coalesce(F.col(name), F.lit(False))

    flags = ["scam", "fake", "restricted", "deleted", "bot"]
    any_flag = flag("is_scam") | flag("is_fake") | flag("is_restricted") | flag("is_deleted") | flag("is_bot")
    return audience.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("accounts"),
        F.count_if(F.col("dc_id") != 0).alias("with_dc"),
        F.count_if(F.col("dc_id").isin(FOREIGN_DC)).alias("foreign_dc"),
        F.count_if(F.col("dc_id").isin(NATIVE_DC)).alias("native_dc"),
        *[F.count_if(F.col("dc_id") == dc).alias(f"dc_{dc}") for dc in range(1, 6)],
        F.count_if(flag("is_premium")).alias("premium"),
        *[F.count_if(flag(f"is_{name}")).alias(f"n_{name}") for name in flags],
        F.count_if(any_flag).alias("n_flagged"),
    )


def unique_accounts(audience: DataFrame) -> DataFrame:
    """One row per known account of a channel."""
    return audience.where(F.col("user_id").isNotNull() & (F.col("user_id") != 0)).dropDuplicates(["channel_id", "user_id"])


def once_each(audience: DataFrame) -> DataFrame:
    """Every known account of a channel once; accounts without an id stay as they are.

    Of several rows of an account the least one stays, by data centre and flags in the order of ``FACTS``, nulls first.
    """
    known = F.col("user_id").isNotNull() & (F.col("user_id") != 0)
    facts = [c for c in FACTS if c in audience.columns]
    first = audience.where(known).groupBy("channel_id", "user_id").agg(F.min(F.struct(*facts)).alias("facts"))
    return first.select("channel_id", "user_id", "facts.*").unionByName(audience.where(~known | F.col("user_id").isNull()).select("channel_id", "user_id", *facts))


def forensics(audience: DataFrame) -> DataFrame:
    """All audience statistics of every channel with their penalties; repeated accounts count once."""
    audience = once_each(audience)
    counts = account_counts(audience)
    pairs = neighbour_pairs(audience)
    both = counts.join(pairs, "channel_id", "left").withColumns({
        "ids": F.coalesce("ids", F.lit(0)), "neighbour_pairs": F.coalesce("neighbour_pairs", F.lit(0)),
    })
    complete = F.col("accounts") >= MIN_ACCOUNTS
    known_ids = complete & (F.col("ids") >= MIN_ACCOUNTS)
    ratio = F.when(known_ids, safe_ratio(F.col("neighbour_pairs"), F.col("ids") - 1)).otherwise(F.lit(0.0))
    foreign = F.when(
        complete & (F.col("with_dc") >= 5), safe_ratio(F.col("foreign_dc"), F.col("with_dc"))
    ).otherwise(F.lit(0.0))
    premium = F.when(complete, safe_ratio(F.col("premium"), F.col("accounts"))).otherwise(F.lit(0.0))
    rated = both.withColumns({
        "complete": complete, "neighbour_raw": ratio, "foreign_raw": foreign, "premium_raw": premium,
    }).withColumns({
        "neighbour_ratio": half_even(F.col("neighbour_raw"), 3),
        "clustered": F.col("neighbour_raw") > 0.30,
        "suspicious": (F.col("neighbour_raw") > 0.15) & (F.col("neighbour_raw") <= 0.30),
        "foreign_ratio": half_even(F.col("foreign_raw"), 3),
        "geo_mismatch": F.col("foreign_raw") > 0.75,
        "premium_ratio": half_even(F.col("premium_raw"), 3),
        "premium_count": F.when(F.col("complete"), F.col("premium")).otherwise(F.lit(0)),
        "flagged": F.col("complete") & ((F.col("n_scam") > 0) | (F.col("n_fake") > 0)),
    })
    return rated.withColumns({
        "cluster_penalty": F.when(F.col("clustered"), -100).otherwise(0),
        "geo_penalty": F.when(F.col("geo_mismatch"), -50).otherwise(0),
        "premium_penalty": F.when(~F.col("complete"), 0).when(F.col("premium") == 0, -20)
        .when(F.col("premium_raw") > 0.05, 10).otherwise(0),
        "flag_penalty": F.when(F.col("flagged"), -10).otherwise(0),
    }).withColumns({
        "total_penalty": F.col("cluster_penalty") + F.col("geo_penalty") + F.col("premium_penalty") + F.col("flag_penalty"),
        "status": F.when(F.col("complete"), "complete").otherwise("insufficient_data"),
    })


def first_flagged(audience: DataFrame, keep: int = 10) -> DataFrame:
    """The first flagged accounts of every channel with the list of their flags."""
    names = ["scam", "fake", "restricted", "deleted", "bot"]
    flags = F.array_compact(F.array(*[F.when(F.col(f"is_{n}"), F.lit(n)) for n in names]))
    window = W.partitionBy("channel_id").orderBy("user_id")
    return (
        audience.withColumn("flags", flags).where(F.size("flags") > 0)
        .withColumn("position", F.row_number().over(window)).where(F.col("position") <= keep)
        .select("channel_id", "position", "user_id", "username", "flags")
    )


def supplemented(sample: DataFrame, known: DataFrame, comments: DataFrame, minimum: int = MIN_ACCOUNTS) -> DataFrame:
    """Sampled accounts, and where a channel has fewer than the minimum also the known authors of its comments."""
    sizes = sample.groupBy("channel_id").agg(F.count(F.lit(1)).alias("size"))
    full = sizes.where(F.col("size") >= minimum).select("channel_id")
    authors = comments.select("channel_id", "user_id").distinct()
    extra = (
        known.join(full, "channel_id", "left_anti").join(authors, ["channel_id", "user_id"], "left_semi")
        .join(sample.select("channel_id", "user_id"), ["channel_id", "user_id"], "left_anti")
    )
    return sample.withColumn("supplement", F.lit(False)).unionByName(extra.withColumn("supplement", F.lit(True)))
