"""Metric values to points."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.queries import Query
from trustlens.functions import points as P
from trustlens.functions import scalars as S
from trustlens.plans.scoring import add_points, rated_metrics, with_forensics
from trustlens.sources.samples import as_of

QUERIES: dict[str, Query] = {}


def pointed(t):
    return add_points(with_forensics(rated_metrics(t.posts, t.channels, as_of()), t.audience))


def pick(name: str, *columns):
    QUERIES[name] = lambda t: pointed(t).select("channel_id", *[c() if callable(c) else c for c in columns])


pick("PTS-01", "cv_points")
pick("PTS-02", "reach_points")
pick("PTS-03", "reactions_max", "reaction_points")
pick("PTS-04", "forwards_max", "forward_points")
pick("PTS-05", "posts_per_day", "regularity_points")
pick("PTS-06", "comments_max", "comment_points")
pick("PTS-07", "er_status", "er_points")
pick("PTS-08", "stability_points")
pick("PTS-09", "age_days", "age_points")
pick("PTS-10", "premium_count", "premium_points")
pick("PTS-11", "source_points")
pick("PTS-12", "is_verified", lambda: P.verified_points().alias("verified_points"))
pick("PTS-13", lambda: P.decay_zone(F.col("decay")).alias("zone"))
pick("PTS-14", "comments_max", "reactions_max", "forwards_max")
pick("PTS-15", "accounts", lambda: P.scoring_mode(F.col("accounts")).alias("scoring_mode"))
pick("PTS-16", "age_days", lambda: P.age_status(F.col("age_days")).alias("age_status"))


def scalar(name: str):
    def add(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return add


@scalar("SCL-01")
def _(t):
    return t.posts.select("post_id", S.reactions_total(F.col("reactions")).alias("reacted"))


@scalar("SCL-02")
def _(t):
    return t.posts.select("post_id", F.inline(S.positive_reactions(F.col("reactions"))))


@scalar("SCL-03")
def _(t):
    return t.channels.select("channel_id", S.age_days(F.col("created_at"), as_of()).alias("age_days"))


@scalar("SCL-04")
def _(t):
    return t.channels.select("channel_id", "members", S.size_class(F.col("members")).alias("size_class"))
