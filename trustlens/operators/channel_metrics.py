"""Per-channel metrics over all posts of a channel.

Positions within a channel (newest first) come from two levels: a window over the posts of one day of the channel, and running totals
over one row per day. So a channel that owns a third of all posts is spread over as many groups as it has days, and no text or list of posts of
one channel meets in a task. Everything else is a grouped aggregate with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlens.constants import POSTING_DEFAULT, POSTING_MULTIPLIERS, POSTING_TIERS, SIMPLE_EMOJI
from trustlens.functions.scalars import cv_from_sums, half_even, reactions_total, safe_ratio

PRIVATE_LINK = r"(?i)t\.me/(?:\+|joinchat/)([a-zA-Z0-9_-]+)"
PUBLIC_LINK = r"(?i)t\.me/([a-zA-Z][a-zA-Z0-9_]{3,})"


def newest_first() -> list[Column]:
    return [F.col("ts").desc_nulls_last(), F.col("post_id").desc()]


def placed(
    rows: DataFrame, counted: dict[str, Column], carried: dict[str, Column] | None = None, bucket: Column | None = None, by: tuple[str, ...] = ("ts", "post_id"), ascending: bool = False,
    slim: DataFrame | None = None,
) -> DataFrame:
    """Running counts over the rows of a channel in the order of ``by``, newest first unless ``ascending``; nulls come last.

    ``counted`` names conditions; each gives a column with the number of such rows up to and including the row, and ``<name> of all``
    with the number in the channel. ``carried`` names values of the row before. ``bucket`` must rise with the first
    column of ``by``; it is the day of the date if nothing else is said. ``slim`` holds the same rows without what is costly to make: the
    running totals are counted there. Rows are shuffled once, by channel and bucket.
    """
    carried = carried or {}
    bucket = F.unix_date(F.to_date(by[0])).cast("bigint") if bucket is None else bucket

    def known(channel: Column, place: Column) -> dict[str, Column]:
        """A channel and its bucket as numbers without null, so that the window and the join need one exchange."""
        missing = channel.isNull().cast("int") + 2 * place.isNull().cast("int")
        return {"channel": F.coalesce(channel, F.lit(0)), "bucket": F.coalesce(place, F.lit(0)), "missing": missing}

    last = (F.max_by if ascending else F.min_by)
    buckets = (rows if slim is None else slim).groupBy(F.col("channel_id").alias("b channel"), bucket.alias("b bucket")).agg(
        *[F.count_if(condition).alias(f"b {name} n") for name, condition in counted.items()],
        *[last(value, F.struct(*by)).alias(f"b {name} last") for name, value in carried.items()],
    )
    channel = W.partitionBy("b channel")
    line = channel.orderBy(F.col("b bucket").asc_nulls_last() if ascending else F.col("b bucket").desc_nulls_last())
    before = line.rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.select(
        *[key.alias(f"b key {k}") for k, key in known(F.col("b channel"), F.col("b bucket")).items()],
        *[F.coalesce(F.sum(f"b {name} n").over(before), F.lit(0)).alias(f"b {name} before") for name in counted],
        *[F.sum(f"b {name} n").over(channel).alias(f"{name} of all") for name in counted],
        *[F.lag(f"b {name} last").over(line).alias(f"b {name} lag") for name in carried],
    )
    order = [F.col(c).asc_nulls_last() if ascending else F.col(c).desc_nulls_last() for c in by]
    keys = known(F.col("channel_id"), bucket)
    inside = W.partitionBy(*[f"own {k}" for k in keys]).orderBy(*order)
    local = rows.select("*", *[key.alias(f"own {k}") for k, key in keys.items()])
    local = local.select(
        "*", F.row_number().over(inside).alias("own number"),
        *[F.sum(condition.cast("int")).over(inside.rowsBetween(W.unboundedPreceding, 0)).alias(f"own {name}") for name, condition in counted.items()],
        *[F.lag(value).over(inside).alias(f"own {name} lag") for name, value in carried.items()],
    )
    same = [F.col(f"own {k}") == F.col(f"b key {k}") for k in keys]
    mine = [F.col(f"`{c}`") for c in rows.columns if c not in counted and c not in carried]
    return local.join(buckets, same).select(
        *mine, *[(F.col(f"own {name}") + F.col(f"b {name} before")).alias(name) for name in counted], *[F.col(f"{name} of all") for name in counted],
        *[F.when(F.col("own number") > 1, F.col(f"own {name} lag")).otherwise(F.col(f"b {name} lag")).alias(name) for name in carried],
    )


def numbered_posts(posts: DataFrame) -> DataFrame:
    """All posts of every channel, numbered by ``rn`` from 1 (newest)."""
    return placed(posts, {"rn": F.lit(True)}).drop("rn of all")


def newest_posts(posts: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` posts of every channel, numbered by ``rn`` from 1 (newest); limited below the shuffle."""
    window = W.partitionBy("channel_id").orderBy(*newest_first())
    return posts.withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= keep)


def may_link(text: Column) -> Column:
    """Cheap byte search that every text with a channel link passes; spares most texts the pattern."""
    return text.contains(".me/") | text.contains(".ME/") | text.contains(".Me/") | text.contains(".mE/")


def flag_links(posts: DataFrame) -> DataFrame:
    """Replace the text by two link flags, so that no text goes through the shuffle."""
    text = F.col("text")
    return posts.withColumns({
        "has_private": F.when(may_link(text), text.rlike(PRIVATE_LINK)).otherwise(False),
        "has_public": F.when(may_link(text), text.rlike(PUBLIC_LINK)).otherwise(False),
    }).drop("text")


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def _square(value: Column) -> Column:
    return value.cast("double") * value


def describe_posts(posts: DataFrame) -> DataFrame:
    """Post-level quantities that need no other post."""
    counts = F.filter(
        F.coalesce(F.col("reactions.count"), F.array().cast("array<bigint>")), lambda c: c > 10
    )
    n = F.size(counts)
    total = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c)
    squares = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c.cast("double") * c)
    simple = F.filter(F.col("reactions"), lambda r: r["emoji"].isin(SIMPLE_EMOJI))
    emoji = F.transform(F.col("reactions"), lambda r: F.coalesce(r["emoji"], F.lit("?")))
    return posts.withColumns({
        "views": F.coalesce("views", F.lit(0)),
        "forwards": F.coalesce("forwards", F.lit(0)),
        "replies": F.coalesce("replies", F.lit(0)),
        "reacted": reactions_total(F.col("reactions")),
        "simple_reacted": reactions_total(simple),
        "emoji": emoji,
        "has_reactions": F.size(F.coalesce(F.col("reactions"), F.array())) > 0,
        "reactions_known": F.col("reactions").isNotNull(),
        "rankable": n >= 3,
        "flat": (n >= 3) & (cv_from_sums(n, total, squares, sample=False) * 100 < 15),
        "source_id": F.nullif(F.col("forward_from.id"), F.lit(0).cast("bigint")),
        "is_repost": F.col("forward_from").isNotNull(),
    })


def place_posts(described: DataFrame) -> DataFrame:
    """Quantities that depend on the other posts of the channel."""
    viewed = (F.col("views") > 0) & F.col("ts").isNotNull()
    ranked = placed(described, {"rn": F.lit(True), "viewed_rank": viewed}, {"later_ts": F.col("ts")}).withColumns({
        "viewed": viewed,
        "viewed_rank": F.when(viewed, F.col("viewed_rank")),
        "viewed_count": F.col("viewed_rank of all"),
        "gap": F.unix_micros("later_ts") - F.unix_micros("ts"),
    }).drop("later_ts", "rn of all", "viewed_rank of all")
    quarter = F.floor(F.col("viewed_count") / 4)
    wide = F.greatest(quarter, F.lit(3))
    return ranked.withColumns({
        "is_new": F.col("viewed_rank") <= quarter,
        "is_old": F.col("viewed_rank") > F.col("viewed_count") - quarter,
        "er_new": F.col("viewed_rank") <= wide,
        "er_old": F.col("viewed_rank") > F.col("viewed_count") - wide,
        "er": F.when(viewed, F.col("reacted") / F.col("views") * 100),
    })


def _kinds(described: DataFrame) -> DataFrame:
    """Per channel: posts of the most frequent source, and number of different emoji, where 3 stands for three or more."""
    sources = described.where(F.col("source_id").isNotNull()).groupBy("channel_id", "source_id").agg(F.count(F.lit(1)).alias("c"))
    tops = sources.select("channel_id", "c", F.lit(0).cast("bigint").alias("e"))
    emoji = described.select("channel_id", F.explode(F.array_distinct("emoji")).alias("emoji")).distinct()
    types = emoji.select("channel_id", F.lit(0).cast("bigint").alias("c"), F.lit(1).cast("bigint").alias("e"))
    both = tops.unionByName(types).groupBy("channel_id").agg(F.max("c").alias("source_top"), F.least(F.sum("e"), F.lit(3)).cast("int").alias("emoji_types"))
    return both.withColumnRenamed("channel_id", "kinds_channel")


def _sums(sample: DataFrame) -> DataFrame:
    viewed, gap, reacted, views = F.col("viewed"), F.col("gap"), F.col("reacted"), F.col("views")
    early = (F.col("rn") <= 5) & F.col("has_reactions")
    aggregates = {
        "posts": F.count(F.lit(1)),
        "dated": F.count("ts"),
        "total_views": F.sum("views"),
        "total_forwards": F.sum("forwards"),
        "total_reactions": F.sum("reacted"),
        "total_replies": F.sum("replies"),
        "viewed_posts": _count(views > 0),
        "dated_viewed": _count(viewed),
        "views_sq": _total(F.when(views > 0, _square(views))),
        "new_views": _total(F.when(F.col("is_new"), views)),
        "old_views": _total(F.when(F.col("is_old"), views)),
        "er_new_sum": _total(F.when(F.col("er_new"), F.col("er"))),
        "er_old_sum": _total(F.when(F.col("er_old"), F.col("er"))),
        "first_ts": F.min("ts"),
        "last_ts": F.max("ts"),
        "reactions_seen": F.bool_or("reactions_known"),
        "reacted_posts": _count(reacted > 0),
        "reacted_sq": _total(F.when(reacted > 0, _square(reacted))),
        "reacted_max": F.max("reacted"),
        "gaps": _count(gap > 0),
        "gap_sum": _total(F.when(gap > 0, gap)),
        "gap_sq": _total(F.when(gap > 0, _square(gap))),
        "source_posts": F.count("source_id"),
        "reposts": _count(F.col("is_repost")),
        "simple_reactions": F.sum("simple_reacted"),
        "rankable_posts": _count(F.col("rankable")),
        "flat_posts": _count(F.col("flat")),
        "impossible": F.bool_or((views > 0) & ((F.col("forwards") > views) | (reacted > views))),
        "early_posts": _count(early),
        "early_sum": _total(F.when(early, reacted)),
        "early_sq": _total(F.when(early, _square(reacted))),
    }
    if "has_private" in sample.columns:
        aggregates["private_posts"] = _count(F.col("has_private"))
        aggregates["public_posts"] = _count(F.col("has_public"))
    return sample.groupBy("channel_id").agg(*[column.alias(name) for name, column in aggregates.items()])


def er_status(posts: Column, er_old: Column, trend: Column) -> Column:
    return (
        F.when(posts < 12, "insufficient_data").when(er_old < 0.1, "always_dead").when(trend >= 1.1, "growing")
        .when(trend >= 0.9, "stable").when(trend >= 0.7, "declining").otherwise("dying")
    )


def channel_metrics(posts: DataFrame) -> DataFrame:
    """One row of metrics per channel, from all its posts.

    ``posts`` may carry ``text``; link counts are then included.
    """
    described = describe_posts(flag_links(posts) if "text" in posts.columns else posts)
    s = _sums(place_posts(described)).join(_kinds(described), F.col("channel_id").eqNullSafe(F.col("kinds_channel")), "left").drop("kinds_channel")
    s = s.withColumns({"source_top": F.coalesce("source_top", F.lit(0)), "emoji_types": F.coalesce("emoji_types", F.lit(0))})
    quarter = F.floor(F.col("dated_viewed") / 4)
    er_quarter = F.greatest(quarter, F.lit(3))
    decay_known = (F.col("posts") >= 12) & (quarter >= 3)
    rest = F.when(F.col("reacted_posts") > 3, 1).otherwise(0)
    seconds = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1000000
    days = F.greatest(seconds / 86400, F.lit(0.1))
    enough_reacted = F.col("reacted_posts") >= 3
    stability = cv_from_sums(
        F.col("reacted_posts") - rest,
        F.col("total_reactions") - rest * F.col("reacted_max"),
        F.col("reacted_sq") - rest * _square(F.col("reacted_max")),
        sample=True,
    )
    s = s.withColumns({
        "avg_views": safe_ratio(F.col("total_views"), F.col("viewed_posts")),
        "cv_views": cv_from_sums(F.col("viewed_posts"), F.col("total_views"), F.col("views_sq"), sample=True) * 100,
        "forward_rate": safe_ratio(F.col("total_forwards"), F.col("total_views"), 100),
        "reaction_rate": safe_ratio(F.col("total_reactions"), F.col("total_views"), 100),
        "avg_comments": safe_ratio(F.col("total_replies"), F.col("posts")),
        "decay_known": decay_known,
        "decay": F.when(
            decay_known, safe_ratio(F.col("old_views"), F.col("new_views"), default=1.0)
        ).otherwise(F.lit(1.0)),
        "posts_per_day_raw": F.when(F.col("dated") >= 2, F.col("dated") / days).otherwise(F.lit(0.0)),
        "span_days": F.when(F.col("dated") >= 2, half_even(days, 1)).otherwise(F.lit(0.0)),
        "reactions_on": (F.col("total_reactions") > 0) | F.col("reactions_seen"),
        "stability_cv": F.when(enough_reacted, half_even(stability * 100, 1)).otherwise(F.lit(50.0)),
        "stability_top": F.when(
            enough_reacted, half_even(safe_ratio(F.col("reacted_max"), F.col("total_reactions")), 3)
        ).otherwise(F.lit(0.2)),
        "er_new": F.when(F.col("dated_viewed") >= 12, F.col("er_new_sum") / er_quarter).otherwise(F.lit(0.0)),
        "er_old": F.when(F.col("dated_viewed") >= 12, F.col("er_old_sum") / er_quarter).otherwise(F.lit(0.0)),
        "source_share": safe_ratio(F.col("source_top"), F.col("source_posts")),
        "repost_ratio": F.col("reposts") / F.col("posts"),
        "interval_cv": cv_from_sums(F.col("gaps"), F.col("gap_sum"), F.col("gap_sq"), sample=False),
        "simple_share": safe_ratio(F.col("simple_reactions"), F.col("total_reactions")),
        "reactions_per_post": F.col("total_reactions") / F.col("posts"),
        "flatness_cv": cv_from_sums(F.col("early_posts"), F.col("early_sum"), F.col("early_sq"), sample=False) * 100,
    })
    return s.withColumns({
        "posts_per_day": half_even(F.col("posts_per_day_raw"), 1),
        "er_trend": F.when(
            (F.col("dated_viewed") >= 12) & (F.col("er_old") >= 0.1), F.col("er_new") / F.nullif(F.col("er_old"), F.lit(0.0))
        ),
        "flatness_on": (F.col("early_posts") >= 3) & (F.col("early_sum") > 0) & (F.col("flatness_cv") < 10),
    }).withColumn("er_status", er_status(F.col("dated_viewed"), F.col("er_old"), F.col("er_trend")))


def posting_tier(category: Column) -> list[Column]:
    """(active, heavy, spam) bounds of a category; a fixed 16-entry lookup as a CASE expression."""
    groups: dict[tuple, list[str]] = {}
    for name, tier in POSTING_TIERS.items():
        groups.setdefault(tier, []).append(name)
    out = []
    for position in range(3):
        bound = F.when(F.lit(False), POSTING_DEFAULT[position])
        for tier, names in groups.items():
            bound = bound.when(category.isin(names), tier[position])
        out.append(bound.otherwise(POSTING_DEFAULT[position]))
    return out


def posting_status(posts_per_day: Column, category: Column, dated: Column) -> Column:
    active, heavy, spam = posting_tier(category)
    return (
        F.when(dated < 2, "insufficient_data").when(posts_per_day < active, "normal")
        .when(posts_per_day < heavy, "active").when(posts_per_day < spam, "heavy").otherwise("spam")
    )


def posting_multiplier(status: Column) -> Column:
    active, heavy, spam = POSTING_MULTIPLIERS
    return F.when(status == "active", active).when(status == "heavy", heavy).when(status == "spam", spam).otherwise(1.0)


def private_links(metrics: DataFrame, category: Column, comments_on: Column) -> DataFrame:
    """Share of posts advertising private invites, with the multiplier of the scan profile."""
    ads = F.col("private_posts") + F.col("public_posts")
    ratio = safe_ratio(F.col("private_posts"), ads)
    base = F.when(ratio >= 1.0, 0.25).when(ratio > 0.8, 0.35).when(ratio > 0.6, 0.50).otherwise(1.0)
    crypto = F.when((category == "CRYPTO") & (ratio > 0.4), 0.45).otherwise(1.0)
    hidden = F.when(~comments_on & (ratio > 0.5), 0.40).otherwise(1.0)
    return metrics.withColumns({
        "ad_posts": ads,
        "private_ratio": half_even(ratio, 2),
        "private_multiplier": F.least(base, crypto, hidden),
    })


def group_variation(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Coefficient of variation of a whole-number column per group, sample (percent) and population."""
    v = F.col(value)
    sums = rows.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("values"), F.sum(v).alias("total"), F.sum(_square(v)).alias("squares")
    )
    n, total, squares = F.col("values"), F.col("total"), F.col("squares")
    return sums.withColumns({
        "cv_sample_percent": cv_from_sums(n, total, squares, sample=True) * 100,
        "cv_population": cv_from_sums(n, total, squares, sample=False),
    })


def emoji_histogram(sample: DataFrame) -> DataFrame:
    """Reactions per channel and emoji, with the number of emoji and the share of the simple ones.

    The histogram windows only see one row per emoji.
    """
    exploded = sample.select("channel_id", F.inline("reactions"))
    counted = exploded.groupBy("channel_id", F.coalesce("emoji", F.lit("?")).alias("emoji")).agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("reactions")
    )
    channel = W.partitionBy("channel_id")
    simple = F.sum(F.when(F.col("emoji").isin(SIMPLE_EMOJI), F.col("reactions")).otherwise(0)).over(channel)
    return counted.withColumns({
        "emoji_types": F.count(F.lit(1)).over(channel).cast("int"),
        "simple_share": safe_ratio(simple, F.sum("reactions").over(channel)),
    })


def private_invites(posts: DataFrame, channels: DataFrame) -> DataFrame:
    """Private and public link posts per channel, with the number of different invite codes."""
    found = posts.select(
        "channel_id", "post_id",
        F.when(may_link(F.col("text")), F.regexp_extract_all("text", F.lit(PRIVATE_LINK), F.lit(1))).otherwise(F.array().cast("array<string>")).alias("codes"),
        F.when(may_link(F.col("text")), F.col("text").rlike(PUBLIC_LINK)).otherwise(False).alias("has_public"),
    )
    # posts are counted on rows without a code, and codes on the distinct ones, in one grouped pass over a long table
    rows = found.select("channel_id", F.explode(F.concat(
        F.array(F.struct(F.lit(None).cast("string").alias("code"), (F.size("codes") > 0).alias("private"), F.col("has_public").alias("public"))),
        F.transform(F.array_distinct("codes"), lambda c: F.struct(c.alias("code"), F.lit(False).alias("private"), F.lit(False).alias("public"))),
    )).alias("r")).select("channel_id", "r.*")
    coded = rows.groupBy("channel_id", "code").agg(F.count_if("private").alias("private"), F.count_if("public").alias("public"))
    counts = coded.groupBy("channel_id").agg(F.sum("private").alias("private_posts"), F.sum("public").alias("public_posts"), F.count("code").alias("unique_private"))
    joined = counts.join(channels.select("channel_id", "category", "comments_enabled"), "channel_id")
    return private_links(joined, F.col("category"), F.col("comments_enabled"))


def without_top(described: DataFrame) -> DataFrame:
    """Posts with reactions, minus the strongest one where a channel has more than three."""
    reacted = described.where(F.col("reacted") > 0)
    tops = reacted.groupBy(F.col("channel_id").alias("top_channel")).agg(
        F.min_by("post_id", F.struct(-F.col("reacted"), F.col("post_id"))).alias("top_post"), F.count(F.lit(1)).alias("reacted_posts")
    )
    joined = reacted.join(tops, F.col("channel_id").eqNullSafe(F.col("top_channel")))
    return joined.where((F.col("post_id") != F.col("top_post")) | (F.col("reacted_posts") <= 3)).drop("top_channel", "top_post")


def first_reacted(described: DataFrame) -> DataFrame:
    """Number of posts among the first five and the first post of the newest twenty that has reactions."""
    eligible = (F.col("rn") <= 20) & F.col("has_reactions")
    return described.groupBy("channel_id").agg(
        _count(F.col("rn") <= 5).alias("early_posts"),
        F.min_by("post_id", F.when(eligible, F.col("rn"))).alias("target_post"),
    )


def dated_posts(posts: DataFrame, require_views: bool = False) -> DataFrame:
    """Posts with a date (and views), numbered by ``age_rank`` from the oldest."""
    kept = posts.where(F.col("ts").isNotNull())
    if require_views:
        kept = kept.where(F.col("views") > 0)
    return placed(kept, {"age_rank": F.lit(True)}, ascending=True).drop("age_rank of all")


def private_codes(posts: DataFrame) -> DataFrame:
    """Distinct private invite codes per channel."""
    codes = F.regexp_extract_all("text", F.lit(PRIVATE_LINK), F.lit(1))
    return posts.where(may_link(F.col("text"))).select("channel_id", F.explode(codes).alias("code")).distinct()
