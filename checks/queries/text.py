"""Text functions and model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.queries import Query
from trustlens.functions import text as X
from trustlens.operators import model_answers as J
from trustlens.operators import text_corpus as T

QUERIES: dict[str, Query] = {}


def query(name: str):
    def add(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return add


@query("TXT-01")
def _(t):
    return t.posts_with_text.select("post_id", F.md5(X.clean_text(F.col("text"))).alias("clean_md5"))


@query("TXT-02")
def _(t):
    named = t.posts_with_text.join(t.channels.select("channel_id", "username"), "channel_id")
    return named.select("post_id", F.array_join(F.sort_array(X.linked_names(F.col("text"), F.col("username"))), ",").alias("links"))


def descriptions(t):
    """Channel descriptions and a few wordings of their own per customer."""
    wording = F.expr("""element_at(array('Реклама: @manager', 'рекламу не продаю', 'Связь @owner_one', 'ad placement and price list',
        'write to us', 'новости дня', 'Только факты', 'без рекламы', 'ad-free', 'paid promotion'), int(c_custkey % 10) + 1)""")
    return t.channels.select(F.col("username").alias("name"), "description").unionByName(
        t.raw("customer").select(F.col("c_name").alias("name"), wording.alias("description")))


@query("TXT-03")
def _(t):
    return descriptions(t).select("name", X.ad_status(F.col("description")).alias("ad_status"))


@query("TXT-04")
def _(t):
    return t.results.select("username", X.ad_status_label(F.col("ad_status")).alias("label"))


@query("TXT-05")
def _(t):
    contacts = X.ad_contacts(F.col("description"), F.col("username"))
    return t.channels.select("username", F.posexplode(contacts).alias("place", "c")).select(
        "username", "place", F.col("c.contact").alias("contact"), F.col("c.type").alias("type"), F.col("c.confidence").alias("confidence"))


@query("TXT-06")
def _(t):
    footers = T.repeating_footers(t.posts_with_footer)
    return T.long_posts(t.posts_with_footer).join(footers, "channel_id").select(
        "channel_id", "post_id", F.md5(T.without_footer(F.col("clean"), F.col("footer"))).alias("body_md5"))


@query("TXT-07")
def _(t):
    answers = t.raw("conversations").select("conv_id", "turn", F.expr("""CASE turn % 4
        WHEN 0 THEN concat('thinking <category> ', element_at(array('tech', 'NEWS', 'WRONG'), int(conv_id % 3) + 1), ' </category>')
        WHEN 1 THEN concat('Category: ', element_at(array('crypto', 'Finance', 'music'), int(conv_id % 3) + 1), ' or TRAVEL')
        WHEN 2 THEN 'It could be NEWS, then TECH, not sure' ELSE 'xxADULTxx and nothing else' END""").alias("answer"))
    return answers.select("conv_id", "turn", X.answer_category(F.col("answer")).alias("category"))


@query("TXT-08")
def _(t):
    labels = t.channels.select("channel_id", F.concat_ws(" + ", F.coalesce("category", F.lit("OTHER")), "category_secondary").alias("label"))
    parts = X.split_category(F.col("label"))
    return labels.select("channel_id", parts["category"].alias("category"), parts["category_secondary"].alias("category_secondary"))


@query("TXT-09")
def _(t):
    return T.channel_types(t.posts_with_text, t.channels.withColumn("category", F.when(F.col("channel_id") % 2 == 0, F.col("category"))))


@query("TXT-10")
def _(t):
    return t.raw("conversations").select("conv_id", "turn", F.md5(X.tidy_summary(F.concat(F.lit('"** '), "text", F.lit('"')))).alias("summary_md5"))


@query("TXT-11")
def _(t):
    flags = F.expr("element_at(array('online CASINO', 'nsfw pictures', 'drug shop', 'harmless', '1win promo', '18+ only', 'fake news'), int(c_custkey % 7) + 1)")
    return t.raw("customer").select("c_custkey", J.flag_category(flags).alias("toxic_category"))


@query("JSN-01")
def _(t):
    return J.flat_fields(J.answer_fields(t.llm_responses)).select(
        "key", "turn", "level", "toxicity", "violence", "ad_percentage", F.array_join("red_flags", ",").alias("red_flags"))


@query("JSN-02")
def _(t):
    posts = t.raw("conversations").groupBy(F.col("conv_id").alias("key")).agg((F.count(F.lit(1)) * 3).alias("posts"))
    return J.flat_record(J.answer_fields(t.llm_responses), posts).select(
        "key", "turn", "category", "is_toxic", "toxic_severity", "toxic_category", "bot_percentage", "trust_score", "authenticity_tier", "ad_percentage")


@query("JSN-01b")
def _(t):
    """Malformed answers, mended."""
    posts = t.raw("conversations").groupBy(F.col("conv_id").alias("key")).agg((F.count(F.lit(1)) * 3).alias("posts"))
    answers = J.flat_record(J.answer_fields(t.malformed_responses), posts)
    return answers.select(
        "key", "turn", "level", "category", "is_toxic", "toxic_severity", "toxic_category", "trust_score", "authenticity_tier", F.size("toxic_evidence").alias("flags"),
        F.col("parsed.ad_percentage").alias("ad_percentage"), F.col("parsed.ad_post_count").alias("ad_post_count"), F.col("parsed.total_posts").alias("total_posts"),
        F.col("parsed.severity_label").alias("severity_label"), F.size("parsed.ad_analysis.ad_post_ids").alias("ad_posts"))
