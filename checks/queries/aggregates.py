"""Aggregations and window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.queries import Query
from trustlens.functions import scalars as S
from trustlens.operators import audience as A
from trustlens.operators import catalogue as C
from trustlens.operators import channel_metrics as M
from trustlens.operators import lifecycle as L
from trustlens.operators import model_answers as J
from trustlens.operators import text_corpus as T
from trustlens.operators import usage as U
from trustlens.operators import usage_sketches as SK
from trustlens.plans.scoring import rated_metrics
from trustlens.session import scratch_dir
from trustlens.sources.samples import as_of

QUERIES: dict[str, Query] = {}


def query(name: str):
    def add(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return add


def r4(name: str):
    return F.round(name, 4).alias(name)


def metrics(t):
    return rated_metrics(t.posts, t.channels, as_of())


def pick(name: str, *columns):
    """A query that shows some metric columns per channel."""
    QUERIES[name] = lambda t: metrics(t).select("channel_id", *[c() if callable(c) else c for c in columns])


@query("AGG-01")
def _(t):
    return M.group_variation(t.posts, ["channel_id"], "replies").select(
        "channel_id", "values", r4("cv_sample_percent"), r4("cv_population")
    )


pick("AGG-02", lambda: r4("cv_views"))
pick("AGG-03", "members", lambda: r4("reach"))
pick("AGG-04", lambda: r4("forward_rate"))
pick("AGG-05", lambda: r4("reaction_rate"))
pick("AGG-06", "decay_known", lambda: r4("decay"))
pick("AGG-07", "posts_per_day", "span_days", "posting_status", "posting_multiplier")
pick("AGG-08", "reactions_on")
pick("AGG-09", "reacted_posts", "stability_cv", "stability_top")
pick("AGG-10", lambda: F.round("er_new", 3).alias("er_new"), lambda: F.round("er_old", 3).alias("er_old"),
     lambda: F.round("er_trend", 3).alias("er_trend"), "er_status")
pick("AGG-11", "source_posts", lambda: r4("source_share"))
pick("AGG-12", "reposts", lambda: r4("repost_ratio"))
pick("AGG-13", "posts", "total_views", "total_forwards", "total_reactions",
     lambda: S.half_even(F.col("total_views") / F.col("posts"), 1).alias("avg_views_all"))
pick("AGG-14", "total_replies", lambda: r4("avg_comments"))


@query("AGG-15")
def _(t):
    return M.emoji_histogram(t.posts).select("channel_id", "emoji", "reactions", "emoji_types", r4("simple_share"))


pick("AGG-16", "rankable_posts", "flat_posts", lambda: F.round(S.safe_ratio(F.col("flat_posts"), F.col("rankable_posts")), 4).alias("flat_share"))
pick("AGG-17", "early_posts", "early_sum", lambda: r4("flatness_cv"), "flatness_on")


@query("AGG-18")
def _(t):
    return M.private_invites(t.posts_with_text, t.channels).select(
        "channel_id", "private_posts", "ad_posts", "private_ratio", "private_multiplier", "unique_private"
    )


def forensic(name: str, *columns: str):
    QUERIES[name] = lambda t: A.forensics(t.audience).select("channel_id", *columns)


forensic("AGG-19", "with_dc", "foreign_dc", "native_dc", "foreign_ratio", "geo_mismatch", "geo_penalty")
forensic("AGG-20", "accounts", "premium", "premium_ratio", "premium_penalty")
forensic("AGG-21", "n_scam", "n_fake", "n_restricted", "n_deleted", "n_bot", "n_flagged", "flagged", "flag_penalty")
forensic("AGG-22", "accounts", "status", "cluster_penalty", "geo_penalty", "premium_penalty", "flag_penalty", "total_penalty")


@query("AGG-23")
def _(t):
    return C.status_histogram(t.results)


@query("AGG-24")
def _(t):
    return C.category_histogram(t.results)


@query("AGG-25")
def _(t):
    return C.with_share(C.category_histogram(t.results)).select("category", "channels", r4("share"))


@query("AGG-26")
def _(t):
    return C.category_prices(t.results)


@query("AGG-27")
def _(t):
    users = U.daily_active_users(U.recent(t.usage_events, as_of(), 7))
    return users.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "users")


@query("AGG-28")
def _(t):
    return U.event_summary(U.recent(t.usage_events, as_of(), 7))


@query("AGG-29")
def _(t):
    return U.conversion_funnel(U.recent(t.usage_events, as_of(), 7))


@query("AGG-27b")
def _(t):
    """Users of every seven days, exact and by stored sketches that were loaded in two parts, one of them twice."""
    folder = scratch_dir(t.spark, "daily-sketches")
    for part in ("event_id % 3 <> 0", "event_id % 2 = 0", "event_id % 3 = 0"):
        SK.merge_events(t.usage_events.where(part), folder)
    found = SK.measured(SK.rolling_estimates(SK.read_sketches(t.spark, folder), 7), SK.rolling_exact(t.usage_events, 7))
    return found.where("stage = 'users'").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "users", (F.col("error") < 0.03).alias("close"))


@query("AGG-29b")
def _(t):
    """Funnel stages of every seven days, exact and by sketches."""
    found = SK.measured(SK.rolling_estimates(SK.daily_sketches(t.usage_events), 7), SK.rolling_exact(t.usage_events, 7))
    return found.where("stage <> 'users'").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "stage", "users", (F.col("error") < 0.03).alias("close"))


@query("AGG-30")
def _(t):
    accounts = t.audience.unionByName(t.audience.where("user_id % 3 = 0"))
    return A.unique_accounts(accounts).select("channel_id", "user_id", "username")


@query("AGG-31")
def _(t):
    return T.repeating_footers(t.posts_with_footer).select("channel_id", "footer", "footer_posts")


@query("AGG-32")
def _(t):
    return J.ad_share(J.answer_fields(t.llm_responses)).select("key", "turn", "ad_percentage")


@query("AGG-33")
def _(t):
    return J.comment_authenticity(J.answer_fields(t.llm_responses)).select("key", "turn", "bot_percentage", "trust_score")


@query("AGG-34")
def _(t):
    return J.toxicity(J.answer_fields(t.llm_responses)).select(
        "key", "turn", "is_toxic", "toxic_category", "confidence", "toxic_ratio"
    )


@query("WIN-01")
def _(t):
    return M.newest_posts(t.posts, 50).select("channel_id", "post_id", "rn")


@query("WIN-02")
def _(t):
    return M.place_posts(M.describe_posts(t.posts)).where("viewed").select(
        "channel_id", "post_id", "viewed_rank", "viewed_count", "is_new", "is_old"
    )


@query("WIN-03")
def _(t):
    pairs = A.neighbour_pairs(t.audience)
    return pairs.select(
        "channel_id", "ids", "neighbour_pairs",
        F.round(S.safe_ratio(F.col("neighbour_pairs"), F.col("ids") - 1), 4).alias("neighbour_ratio"),
    )


pick("WIN-04", "gaps", lambda: F.round("interval_cv", 3).alias("interval_cv"))


@query("WIN-05")
def _(t):
    return M.without_top(M.describe_posts(t.posts)).select("channel_id", "post_id", "reacted")


@query("WIN-06")
def _(t):
    return M.first_reacted(M.newest_posts(M.describe_posts(t.posts), 20)).select("channel_id", "early_posts", "target_post")


@query("WIN-07")
def _(t):
    return L.latest_by_key(t.favorites, ["user_id", "username"], ["added_at", "seq"]).select(
        "user_id", "username", F.date_format("added_at", "yyyy-MM-dd").alias("added_on"), "seq"
    )


@query("WIN-08")
def _(t):
    latest = L.latest_by_key(t.favorites, ["user_id", "username"], ["added_at", "seq"])
    return L.newest_per_user(latest, 100).select("user_id", "username", "position")


@query("WIN-09")
def _(t):
    return L.queue_positions(t.scan_requests, "requested_at", "request_id").select("request_id", "username", "position")
