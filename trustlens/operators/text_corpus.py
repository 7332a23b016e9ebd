"""Per-channel text jobs: footers, prompt corpus, stored content, archives, channel type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlens.functions.text import TYPE_KEYWORDS, TYPE_OF_CATEGORY, clean_text, keyword_mask, strip, type_masks
from trustlens.operators.channel_metrics import placed
from trustlens.session import set_aside

TAIL_LINES = 17
FREQUENT = 64  # items asked of a sketch; more than 43, and those whose overestimate may rank above
TRACKED = 1024
FOOTER_BYTES = 64 << 20  # of footers broadcast, with 32 for each row


def long_posts(posts: DataFrame) -> DataFrame:
    """All posts with more than 30 characters, cleaned."""
    return posts.where(F.length("text") > 30).select("channel_id", "post_id", "ts", clean_text(F.col("text")).alias("clean"))


def post_tails(posts: DataFrame) -> DataFrame:
    """Per long post the lines with more than 10 characters among its last 200 characters; none if it has 50 characters or fewer."""
    long = F.length("clean") > 50
    tail = F.when(F.length("clean") > 200, F.expr("right(clean, 200)")).otherwise(F.col("clean"))
    lines = F.transform(F.split(tail, "\n"), lambda line, i: F.struct(strip(line).alias("line"), (-i).alias("order")))
    return long_posts(posts).select("channel_id", "post_id", "ts", long.alias("long"), F.when(long, F.filter(lines, lambda x: F.length(x["line"]) > 10)).alias("lines"))


def repeating_footers(posts: DataFrame) -> DataFrame:
    """``footers_of`` some posts."""
    return footers_of(set_aside(post_tails(posts), "tails"))


def footers_of(tails: DataFrame) -> DataFrame:
    """The line that closes at least 40 % of a channel's posts (at least five posts); of several the one seen first, from the newest post on.

    200 characters hold at most ``TAIL_LINES`` such lines, so a line of 40 % of the posts is one of 43 of a channel's lines at least. A mergeable sketch of frequent
    items per channel, which counts each item of more than one in 580 too high by no more than that share, names all of them; those alone are
    counted exactly in a second pass. No text and no window over a channel is shuffled, and rare lines never are. The frequent items and
    the footers are set aside, so that their size is known where lines and texts meet them. Footers go to the texts, whatever the planner's own limit, while
    they have ``FOOTER_BYTES`` at most; beyond that texts are shuffled.
    """
    counts = tails.groupBy("channel_id").agg(F.count(F.lit(1)).alias("texts"), F.count_if("long").alias("endings")).where("texts >= 5 AND endings >= 5")
    lines = tails.where("long").select("channel_id", "ts", "post_id", F.explode("lines").alias("l")).select("channel_id", "ts", "post_id", "l.*", F.xxhash64("l.line").alias("line_hash"))
    sketch = F.call_function("approx_top_k", F.col("line_hash"), F.lit(FREQUENT), F.lit(TRACKED))
    frequent = lines.groupBy("channel_id").agg(sketch.alias("top")).join(counts, "channel_id").select("channel_id", "texts", F.explode("top").alias("f"))
    frequent = set_aside(frequent.where(F.col("f.count") >= F.col("texts") * 0.4).select("channel_id", "texts", F.col("f.item").alias("line_hash")), "frequent")
    repeated = lines.join(frequent, ["channel_id", "line_hash"]).groupBy("channel_id", "line").agg(
        F.count(F.lit(1)).alias("posts"), F.max(F.struct("ts", "post_id", "order")).alias("first"), F.max("texts").alias("texts")
    ).where(F.col("posts") >= F.col("texts") * 0.4)
    best = F.max_by(F.struct("line", "posts"), "first").alias("best")
    footers = set_aside(repeated.groupBy("channel_id").agg(best).select(
        "channel_id", F.col("best.line").alias("footer"), F.col("best.posts").alias("footer_posts")
    ), "footers")
    size = footers.agg(F.coalesce(F.sum(F.octet_length("footer") + 32), F.lit(0))).first()[0]
    return F.broadcast(footers) if size <= FOOTER_BYTES else footers


def without_footer(text: Column, footer: Column) -> Column:
    """Text up to the footer; a footer at the very start is left alone."""
    at = F.coalesce(F.instr(text, footer), F.lit(0))
    return F.when(at > 1, strip(F.substring(text, F.lit(1), at - 1))).otherwise(text)


def whole(body: Column) -> Column:
    return body


def prompt_posts(posts: DataFrame, form: Callable[[Column], Column] = whole) -> DataFrame:
    """Cleaned posts without footer, still longer than 30 characters, numbered by ``slot`` among all long posts, newest first.

    A body is cut, and ``form`` applied to it, where its text is read; only that is shuffled, once, to be numbered.
    """
    tails = set_aside(post_tails(posts), "tails")
    body = without_footer(F.col("clean"), F.col("footer"))
    cut = long_posts(posts).join(footers_of(tails), "channel_id", "left").select("channel_id", "post_id", "ts", body.alias("body"))
    kept = cut.select("channel_id", "post_id", "ts", F.when(F.length("body") > 30, F.struct(form(F.col("body")).alias("body"))).alias("kept"))
    slim = tails.select("channel_id", "post_id", "ts")
    return placed(kept, {"slot": F.lit(True)}, slim=slim).where("kept is not null").select("channel_id", "slot", "kept.body")


def prompt_comments(comments: DataFrame, form: Callable[[Column], Column] = whole) -> DataFrame:
    """The comments of a channel, cleaned, longer than 5 characters, numbered by ``slot`` among all in the order of their ids; ``form`` as for posts."""
    cut = comments.select("channel_id", "comment_id", clean_text(F.col("text")).alias("body"))
    kept = cut.select("channel_id", "comment_id", F.when(F.length("body") > 5, F.struct(form(F.col("body")).alias("body"))).alias("kept"))
    by = {"bucket": F.floor(F.col("comment_id") / 4096), "by": ("comment_id",), "ascending": True}
    return placed(kept, {"slot": F.lit(True)}, slim=comments, **by).where("kept is not null").select("channel_id", "slot", "kept.body")


def prompt_corpus(posts: DataFrame, comments: DataFrame, form: Callable[[Column], Column] = whole) -> DataFrame:
    """Prompt texts, or a ``form`` of them such as a digest: one row per post and comment, so that no task holds all texts of a channel."""
    return prompt_posts(posts, form).select("channel_id", F.lit("post").alias("kind"), "slot", "body").unionByName(
        prompt_comments(comments, form).select("channel_id", F.lit("comment").alias("kind"), "slot", "body")
    )


def stored_content(posts: DataFrame, comments: DataFrame, audience: DataFrame) -> DataFrame:
    """Content kept for re-classification: every whole text of posts and comments, one row each, comments with their author and premium flag."""
    texts = posts.where(F.length("text") > 0).select(
        "channel_id", F.lit("post").alias("kind"), F.col("post_id").alias("id"), "text", F.lit(None).cast("boolean").alias("is_premium"), F.lit(None).cast("bigint").alias("user_id")
    )
    noted = comments_with_premium(comments, audience)
    return texts.unionByName(noted.select("channel_id", F.lit("comment").alias("kind"), F.col("comment_id").alias("id"), "text", "is_premium", "user_id"))


def comments_with_premium(comments: DataFrame, audience: DataFrame) -> DataFrame:
    """The comments with a text and the premium flag of their author (false when unknown)."""
    premium = audience.where("is_premium").select("channel_id", "user_id").distinct().withColumn("is_premium", F.lit(True))
    written = comments.where(F.length("text") > 0)
    return written.join(premium, ["channel_id", "user_id"], "left").withColumn("is_premium", F.coalesce("is_premium", F.lit(False)))


def text_archive(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Every whole text of posts and comments for later analysis, one row each."""
    return posts.where(F.length("text") > 0).select("channel_id", F.lit("post").alias("kind"), F.col("post_id").alias("id"), "text").unionByName(
        comments.where(F.length("text") > 0).select("channel_id", F.lit("comment").alias("kind"), F.col("comment_id").alias("id"), "text")
    )


def channel_types(posts: DataFrame, channels: DataFrame, newest: int | None = None) -> DataFrame:
    """Channel type by category, else by the keywords of the posts (of the newest ones, if a number is given; empty posts count among them).

    Each post is read once and reduced to a bit set of keywords, which is set aside. The one keyword with
    a blank may also span two neighbouring posts, which is checked from their edges.
    """
    masks = type_masks()
    spanning = 1 << [w for words in TYPE_KEYWORDS.values() for w in words].index("курс валют")
    low = F.lower("text")
    marked = posts.select(
        "channel_id", "post_id", "ts", F.coalesce(F.length("text"), F.lit(0)).alias("size"), F.when(F.length("text") > 0, keyword_mask(F.col("text"))).otherwise(0).alias("mask"),
        low.endswith("курс").alias("ends"), low.startswith("валют").alias("starts"),
    )
    marked = set_aside(marked, "keywords")
    if newest is not None:
        marked = placed(marked, {"rn": F.lit(True)}).where(F.col("rn") <= newest).drop("rn", "rn of all")
    linked = placed(marked.where("size > 0"), {"place": F.lit(True)}, {"ended": F.col("ends")})
    spans = F.when(F.col("starts") & F.coalesce("ended", F.lit(False)), spanning).otherwise(0).cast("bigint")
    merged = linked.withColumn("mask", F.col("mask").bitwiseOR(spans)).groupBy("channel_id").agg(F.bit_or("mask").alias("mask"))
    hits = {name: F.bit_count(F.col("mask").bitwiseAND(F.lit(mask))) for name, mask in masks.items()}
    top = F.greatest(*hits.values())
    by_words = F.when(F.coalesce(top, F.lit(0)) < 3, "GENERAL")
    for name, count in hits.items():
        by_words = by_words.when(count == top, name)
    category = F.upper(F.col("category"))
    by_category = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, kind in TYPE_OF_CATEGORY.items():
        by_category = by_category.when(category == name, kind)
    joined = channels.select("channel_id", "category").join(merged, "channel_id", "left")
    return joined.select(
        "channel_id", F.coalesce(by_category, by_words).alias("channel_type"), F.coalesce(top, F.lit(0)).alias("keyword_hits")
    )
