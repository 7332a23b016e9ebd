"""Active users and funnel stages of rolling periods from stored daily sketches, and the exact counts beside them.

One theta sketch of user ids per day and stage is stored. Sketches merge and do not care for repeats, so late events and repeated loads are merged into their
day, and a period's users are the union of its days: at most ``days`` small rows a period, whatever the number of events. With ``2 ** LG`` entries
a sketch is exact up to that many users and off by about 1.6 % (two standard deviations) beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.operators.usage import FUNNEL
from trustlens.session import set_aside

LG = 14
ALL = "users"
SCHEMA = "stage string, sketch binary, day date"


def staged(events: DataFrame, stages: dict[str, list[str]] = FUNNEL) -> DataFrame:
    """day, stage, user_id: every known user under ``users`` and under each stage the event type belongs to."""
    names = [F.lit(ALL), *[F.when(F.col("event_type").isin(types), F.lit(name)) for name, types in stages.items()]]
    rows = events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select(F.to_date("ts").alias("day"), "user_id", F.explode(F.array_compact(F.array(*names))).alias("stage"))
    return rows


def daily_sketches(events: DataFrame, stages: dict[str, list[str]] = FUNNEL) -> DataFrame:
    """stage, sketch, day; partial aggregation leaves one sketch per task, day and stage for the shuffle."""
    return staged(events, stages).groupBy("day", "stage").agg(F.theta_sketch_agg("user_id", LG).alias("sketch")).select("stage", "sketch", "day")


def read_sketches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def merge_events(events: DataFrame, folder: str, stages: dict[str, list[str]] = FUNNEL) -> None:
    """Merge the events into the stored sketches; only the days they belong to are read and written again."""
    spark = events.sparkSession
    fresh = set_aside(daily_sketches(events, stages), "sketches")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        stored = read_sketches(spark, folder).join(F.broadcast(fresh.select("day").distinct()), "day", "left_semi")
        fresh = fresh.unionByName(stored).groupBy("day", "stage").agg(F.theta_union_agg("sketch", LG).alias("sketch")).select("stage", "sketch", "day")
        fresh = set_aside(fresh, "sketches")
    fresh.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)


def _periods(day: Column, days: int) -> Column:
    """The days whose period of ``days`` days ends there and holds this day."""
    return F.explode(F.sequence(day, F.date_add(day, days - 1)))


def rolling_estimates(sketches: DataFrame, days: int) -> DataFrame:
    """day, stage, estimate: users in the ``days`` days up to each day with events."""
    known = sketches.select(F.col("day").alias("known")).distinct()
    spread = sketches.select(_periods(F.col("day"), days).alias("end"), "stage", "sketch").join(F.broadcast(known), F.col("end") == F.col("known"), "left_semi")
    return spread.groupBy(F.col("end").alias("day"), "stage").agg(F.round(F.theta_sketch_estimate(F.theta_union_agg("sketch", LG))).cast("bigint").alias("estimate"))


def rolling_exact(events: DataFrame, days: int, stages: dict[str, list[str]] = FUNNEL) -> DataFrame:
    """day, stage, users: exact; a user's days are reduced to one row each before they are spread over the periods."""
    rows = staged(events, stages).distinct()
    known = rows.select(F.col("day").alias("known")).distinct()
    spread = rows.select(_periods(F.col("day"), days).alias("end"), "stage", "user_id").distinct().join(F.broadcast(known), F.col("end") == F.col("known"), "left_semi")
    return spread.groupBy(F.col("end").alias("day"), "stage").agg(F.count(F.lit(1)).alias("users"))


def measured(estimates: DataFrame, exact: DataFrame) -> DataFrame:
    """day, stage, users, estimate, error (relative)."""
    both = exact.join(estimates, ["day", "stage"], "left").withColumn("estimate", F.coalesce("estimate", F.lit(0)))
    return both.withColumn("error", F.abs(F.col("estimate") - F.col("users")) / F.col("users"))
