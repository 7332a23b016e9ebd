"""Usage analytics over the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent(events: DataFrame, as_of: Column, days: int) -> DataFrame:
    return events.where(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days)))


def daily_active_users(events: DataFrame) -> DataFrame:
    """Distinct known users per day: users are de-duplicated per day before they are counted."""
    seen = events.where(F.col("user_id").isNotNull()).select(F.to_date("ts").alias("day"), "user_id").distinct()
    return seen.groupBy("day").agg(F.count(F.lit(1)).alias("users"))


def event_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.avg("duration_ms"), 1).alias("avg_duration_ms")
    )


FUNNEL = {"opens": ["app_open"], "browse": ["search_submit", "channel_view"], "detail": ["channel_detail"]}


def conversion_funnel(events: DataFrame, stages: dict[str, list[str]] = FUNNEL) -> DataFrame:
    """Distinct users that reached each stage.

    One row of stage flags per user first, then plain sums: a single shuffle with map-side
    combining instead of one expanded copy of the table per distinct count.
    """
    flags = [F.max(F.col("event_type").isin(types).cast("int")).alias(name) for name, types in stages.items()]
    users = events.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(*flags)
    return users.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in stages])


def top_channels(events: DataFrame, limit: int = 10) -> DataFrame:
    """The channels most often viewed or requested."""
    counted = events.where(F.col("event_type").isin("scan_request", "channel_view") & F.col("username").isNotNull())
    return (
        counted.groupBy("username").agg(F.count(F.lit(1)).alias("events"))
        .orderBy(F.col("events").desc(), "username").limit(limit)
    )
