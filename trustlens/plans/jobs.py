"""Whole jobs over stored tables: score, re-score, export, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from trustlens.operators.catalogue import category_histogram, status_histogram, with_share
from trustlens.operators.network import discovered, outgoing_links
from trustlens.plans.rescore import rescore_all
from trustlens.plans.scoring import score_channels
from trustlens.sources.schemas import read_table
from trustlens.sources.stored_rows import import_rows
from trustlens.sources.tables import export_csv, stored_row


def score_tables(spark: SparkSession, root: str, out: str, as_of: Column) -> None:
    """Score all channels of the posts, channels and audience tables; results are split by status."""
    posts, channels, audience = (read_table(spark, root, name) for name in ("posts", "channels", "audience"))
    scored = score_channels(posts, channels, audience, as_of)
    links = outgoing_links(posts, channels)
    stored_row(scored, as_of, links).write.mode("errorifexists").partitionBy("status").parquet(out)


def rescore_table(spark: SparkSession, results: str, out: str) -> None:
    """New scores of stored results; the stored table is read once and nothing is shuffled."""
    rows = rescore_all(import_rows(spark.read.parquet(results)))
    rows.select("username", "new_score", "new_verdict", "new_status", "stored_trust").write.mode("errorifexists").parquet(out)


def export_table(spark: SparkSession, results: str, out: str, status: str = "GOOD", category: str | None = None) -> None:
    export_csv(spark.read.parquet(results), out, status, category)


def summary(spark: SparkSession, results: str) -> dict[str, DataFrame]:
    rows = spark.read.parquet(results)
    return {"status": status_histogram(rows), "categories": with_share(category_histogram(rows))}


def discover(spark: SparkSession, root: str, results: str, out: str) -> None:
    """Names linked by well-scored channels that no stored row knows yet."""
    posts, channels = (read_table(spark, root, name) for name in ("posts", "channels"))
    discovered(posts, channels, spark.read.parquet(results)).write.mode("errorifexists").parquet(out)
