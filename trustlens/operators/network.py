"""Links between channels: advertised neighbours, discovery edges, multi-hop growth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlens.constants import COLLECT_SCORE
from trustlens.functions.bloom import pruned
from trustlens.functions.text import linked_names
from trustlens.operators.lifecycle import new_names
from trustlens.session import ensure_checkpoint_dir


def neighbour_risk(results: DataFrame) -> DataFrame:
    """How many of the channels each channel advertises are scams or otherwise bad.

    Only bad targets are joined. A target that a large share of channels advertises makes a
    hot join key; the join is a plain equi-join without aggregation on that key, so adaptive
    execution may split it.
    """
    links = results.select("channel_id", "username", F.explode(F.array_distinct("ad_links")).alias("target"))
    bad = results.where(F.col("status").isin("GOOD", "BAD") & ((F.col("verdict") == "SCAM") | (F.col("status") == "BAD"))).select(
        F.col("username").alias("target"), (F.col("verdict") == "SCAM").alias("scam")
    )
    hits = links.where(F.col("target") != F.col("username")).join(bad, "target").groupBy("channel_id").agg(
        F.count_if("scam").alias("scam_count"), F.count_if(~F.col("scam")).alias("bad_count")
    )
    return results.select("channel_id").join(hits, "channel_id", "left").select(
        "channel_id", F.coalesce("scam_count", F.lit(0)).alias("scam_count"), F.coalesce("bad_count", F.lit(0)).alias("bad_count")
    )


def outgoing_links(posts: DataFrame, channels: DataFrame) -> DataFrame:
    """Distinct channel names that the posts of every channel link, mention or forward.

    Names are taken out of the texts before anything is shuffled; the channel's own name is
    removed at the end, when only distinct names are left to join.
    """
    forwards = F.array_compact(F.array(F.col("forward_from.username")))
    names = F.array_union(linked_names(F.col("text")), forwards)
    links = posts.select("channel_id", F.explode(names).alias("link")).distinct()
    owners = channels.select("channel_id", "username")
    return links.join(owners, "channel_id").where(F.col("link") != F.lower("username")).select("channel_id", "username", "link")


def discovered(posts: DataFrame, channels: DataFrame, results: DataFrame, min_score: int = COLLECT_SCORE) -> DataFrame:
    """New names found by channels with a score high enough to be followed."""
    good = results.where((F.col("status") == "GOOD") & (F.col("score") >= min_score)).select("channel_id")
    followed = posts.join(good, "channel_id", "left_semi")
    edges = outgoing_links(followed, channels).select(F.col("link").alias("username"), F.col("username").alias("found_via"))
    return new_names(results, edges)


def reachable(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Names reached from the seeds, with the hop in which each was first seen; all of them unless a number of hops is given.

    Each round shuffles what it touches. Only edges that can start at a name of the last round are joined with it, and only seen
    names that can be among those found are joined for the exact check; Bloom filters tell both before the shuffle. The driver counts the names of each round.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.select("src", "dst")
    last = seeds.select("username").distinct().withColumn("hop", F.lit(0)).checkpoint()
    seen, hop, count = last, 0, last.count()
    while count and (max_hops is None or hop < max_hops):
        hop += 1
        outgoing = pruned(edges, "src", last, "username", count)
        found = outgoing.join(last.select(F.col("username").alias("src")), "src").select(F.col("dst").alias("username")).distinct().checkpoint()
        known = pruned(seen, "username", found, "username", found.count())
        last = found.join(known, "username", "left_anti").withColumn("hop", F.lit(hop)).checkpoint()
        count = last.count()
        seen = seen.unionByName(last)
    return seen


def forward_sources(posts: DataFrame, channels: DataFrame) -> DataFrame:
    """Posts with the name of the channel they were forwarded from, where it is known.

    Posts that are no forwards skip the join, and forwards are counted per source first, so
    a source with very many forwards is one row when it meets the channel table.
    """
    listed = posts.select("post_id", F.col("forward_from.id").alias("source_id"))
    sources = listed.where(F.col("source_id").isNotNull()).select("source_id").distinct()
    names = sources.join(
        channels.select(F.col("channel_id").alias("source_id"), F.lower("username").alias("source_username")), "source_id"
    )
    return listed.join(names, "source_id", "left")
