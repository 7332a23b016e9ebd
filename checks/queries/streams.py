"""Streaming queries, run over everything that is available and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.queries import Query
from trustlens.session import scratch_dir
from trustlens.sources.samples import as_of, usage_view
from trustlens.streaming import feeds as S

QUERIES: dict[str, Query] = {}


def query(name: str):
    def add(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return add


def file_stream(t, rows, purpose: str, files: int = 3):
    """Rows derived from the tables as a stream of files, one file per micro-batch."""
    path = scratch_dir(t.spark, purpose)
    rows.repartition(files).write.parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("STR-01")
def _(t):
    events = t.raw("events")
    stream = t.spark.readStream.schema(events.schema).parquet(f"{t.folder}/events*.parquet")
    counts = S.stream_usage(usage_view(stream, F.lit(1)), scratch_dir(t.spark, "usage-stream"))
    return S.usage_by_day(counts).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("STR-02")
def _(t):
    columns = ["username", "status", "score", "verdict", "trust_factor", "members", "category", "category_secondary", "ad_status",
               "is_verified", "description", "scanned_at"]
    feed = t.results.select(*columns).withColumn("username", F.concat(F.lit("@"), F.upper("username")))
    current = S.stream_results(file_stream(t, feed, "result-feed"), scratch_dir(t.spark, "results-stream"))
    return current.select("username", "status", "score", "verdict", "members", F.unix_timestamp("scanned_at").alias("scanned_at"))


@query("STR-03")
def _(t):
    requests = t.scan_requests.select("username", "requested_at")
    known = t.results.where("status IN ('GOOD', 'BAD')")
    return S.stream_requests(file_stream(t, requests, "request-feed"), known, scratch_dir(t.spark, "requests-stream")).select("username")


@query("STR-04")
def _(t):
    notices = t.channels.select("channel_id")
    scored = S.stream_scores(
        file_stream(t, notices, "notices"), t.posts_with_text, t.channels, t.audience, as_of(), scratch_dir(t.spark, "scores-stream"))
    return scored.select("channel_id", "raw_score", "score", "verdict", "trust_factor", "status")
