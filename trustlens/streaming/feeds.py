"""Feeds as Structured Streaming queries.

Every sink writes one folder per micro-batch and overwrites it when a batch is repeated,
so a restart after a lost driver or executor neither loses nor doubles rows. Upserts are kept as
runs that are merged level by level (``runs``); counts of open days and names seen are keyed state.
State, offsets and output live under one shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from trustlens.functions.scalars import normalise_name
from trustlens.operators.lifecycle import latest_by_key
from trustlens.operators.usage import FUNNEL
from trustlens.plans.scoring import score_channels
from trustlens.sources.tables import clean_requests
from trustlens.streaming.runs import BATCH, current, run_writer


STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",  # a batch writes what it changed
}


def run_available(stream: DataFrame, home: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything that is there in micro-batches and stop; the checkpoint lies beside the output."""
    conf = stream.sparkSession.conf
    before = {k: conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        conf.set(k, v)
    try:
        query = (
            stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/checkpoint")
            .trigger(availableNow=True).foreachBatch(write).start()
        )
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    query.awaitTermination()


def state_rows(spark: SparkSession, home: str, variable: str) -> DataFrame:
    """What the last batch left in a state variable."""
    return spark.read.format("statestore").option("path", f"{home}/checkpoint").option("stateVarName", variable).load()


def batch_writer(home: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink that stores each batch in a folder of its own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{home}/rows/{BATCH}={batch_id}")

    return write


def written(spark: SparkSession, home: str) -> DataFrame:
    return spark.read.parquet(f"{home}/rows")


USAGE_KEY = ["day", "event_type", "user_id"]
COUNTS = "day date, event_type string, user_id bigint, events bigint, duration_sum bigint, durations bigint"
BUCKETS = 64


def usage_counts(events: DataFrame) -> DataFrame:
    """Per day, event type and user: events and duration of the rows given. Counts of several parts add up."""
    counted = events.withColumn("day", F.to_date("ts")).groupBy(*USAGE_KEY)
    return counted.agg(F.count(F.lit(1)).alias("events"), F.sum("duration_ms").alias("duration_sum"), F.count("duration_ms").alias("durations"))


def summed(keys: list[str], sums: dict[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Within each Arrow batch one row per key, so a very frequent key reaches the shuffle as a few rows. ``sums``: how each other column is combined."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by(keys).aggregate(list(sums.items()))
            table = table.select([*keys, *[f"{c}_{how}" for c, how in sums.items()]]).rename_columns([*keys, *sums])
            yield from table.combine_chunks().to_batches()

    return run


def _add(sums: dict, key: tuple, events: int, duration: int | None, durations: int) -> None:
    old = sums.get(key, (0, None, 0))
    total = old[1] if duration is None else duration + (old[1] or 0)
    sums[key] = (old[0] + events, total, old[2] + durations)


class OpenDays(StatefulProcessor):
    """State per day and bucket: the counts of each batch, until the watermark has passed the day.

    Then a timer gives the day's counts, one row per event type and user, and clears the state. Rows of a day that is closed already, and
    rows without a day, are given at once as late ones; no row is dropped and no state is kept for them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getListState("counts", "event_type string, user_id bigint, events bigint, duration_sum bigint, durations bigint")

    @staticmethod
    def given(day: date | None, sums: dict, late: bool) -> Iterator[Row]:
        for (kind, user), values in sums.items():
            yield Row(day=day, event_type=kind, user_id=user, events=values[0], duration_sum=values[1], durations=values[2], late=late)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        sums: dict = {}
        for r in rows:
            _add(sums, (r["event_type"], r["user_id"]), r["events"], r["duration_sum"], r["durations"])
        day = key[0]
        ends = None if day is None else ((day - date(1970, 1, 1)).days + 1) * 86_400_000
        if ends is None or timerValues.getCurrentWatermarkInMs() >= ends:
            yield from self.given(day, sums, True)
        else:
            self.counts.appendList([(*k, *v) for k, v in sums.items()])
            self.handle.registerTimer(ends)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        sums: dict = {}
        for kind, user, *values in self.counts.get():
            _add(sums, (kind, user), *values)
        self.counts.clear()
        yield from self.given(key[0], sums, False)

    def close(self) -> None:
        pass


def stream_usage(events: DataFrame, home: str, delay: str = "1 day") -> DataFrame:
    """Run the usage feed and return the current counts.

    A day is written once, when the watermark passes it; what arrives later is written apart (``late_usage``). The counts are the sums of both
    and of the days that are still open, read from the state, so they are those of all rows, however late these came. The hours of a day
    are spread over buckets by user, so neither a day nor a user is one key.
    """
    hour = F.xxhash64("user_id", F.hour("ts"))
    keyed = events.withWatermark("ts", delay).select(
        F.to_date("ts").alias("day"), F.pmod(hour, F.lit(BUCKETS)).cast("int").alias("bucket"), "event_type", F.col("user_id").cast("bigint").alias("user_id"),
        F.lit(1).cast("bigint").alias("events"), F.col("duration_ms").cast("bigint").alias("duration_sum"), F.col("duration_ms").isNotNull().cast("bigint").alias("durations"),
    )
    combine = summed(["day", "bucket", "event_type", "user_id"], {"events": "sum", "duration_sum": "sum", "durations": "sum"})
    keyed = keyed.mapInArrow(combine, "day date, bucket int, event_type string, user_id bigint, events bigint, duration_sum bigint, durations bigint")
    counted = keyed.groupBy("day", "bucket").transformWithState(OpenDays(), f"{COUNTS}, late boolean", "Append", "EventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("late").parquet(f"{home}/rows/{BATCH}={batch_id}")

    run_available(counted, home, write)
    spark = events.sparkSession
    still_open = state_rows(spark, home, "counts").select("key.day", "list_element.*")
    sums = [F.sum(c).alias(c) for c in ("events", "duration_sum", "durations")]
    return written_usage(spark, home).drop("late", BATCH).unionByName(still_open).groupBy(*USAGE_KEY).agg(*sums)


def written_usage(spark: SparkSession, home: str) -> DataFrame:
    """Counts of closed days and, apart from them by ``late``, what came after the close."""
    return spark.read.schema(f"{COUNTS}, {BATCH} bigint, late boolean").parquet(f"{home}/rows")


def late_usage(spark: SparkSession, home: str) -> DataFrame:
    """Counts of rows that came after their day was closed, with the batch they came in."""
    return written_usage(spark, home).where("late").drop("late")


def usage_by_day(counts: DataFrame) -> DataFrame:
    """Events, active users, mean duration and funnel stages per day from the streamed counts."""
    by_user = counts.groupBy("day", "user_id").agg(
        F.sum("events").alias("events"), F.sum("duration_sum").alias("duration_sum"), F.sum("durations").alias("durations"),
        *[F.max(F.col("event_type").isin(types).cast("int")).alias(name) for name, types in FUNNEL.items()],
    )
    known = F.col("user_id").isNotNull()
    return by_user.groupBy("day").agg(
        F.sum("events").alias("events"), F.count(F.when(known, 1)).alias("users"),
        F.round(F.sum("duration_sum") / F.sum("durations"), 1).alias("avg_duration_ms"),
        *[F.coalesce(F.sum(F.when(known, F.col(name))), F.lit(0)).alias(name) for name in FUNNEL],
    )


def stream_results(feed: DataFrame, home: str) -> DataFrame:
    """Upsert of a result feed by name: the row of the latest batch, and within it the latest scan, wins."""
    def prepare(batch: DataFrame) -> DataFrame:
        named = batch.withColumn("username", normalise_name(F.col("username")))
        return latest_by_key(named, ["username"], ["scanned_at", "score"])

    run_available(feed, home, run_writer(home, ["username"], prepare))
    return current(feed.sparkSession, home, ["username"])


class NewNames(StatefulProcessor):
    """State per name: whether it is known or was accepted. A name is given once, with the earliest request of its batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "taken boolean")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:
        self.taken.update((True,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        known, first = self.taken.exists(), None
        if not known:
            self.taken.update((True,))
        for r in rows:
            known = known or r["is_known"]
            if r["requested_at"] is not None and (first is None or r["requested_at"] < first):
                first = r["requested_at"]
        if not known:
            yield Row(username=key[0], requested_at=first)

    def close(self) -> None:
        pass


def stream_requests(requests: DataFrame, known: DataFrame, home: str) -> DataFrame:
    """New requested names: repeated requests, known names and names accepted earlier are dropped.

    Names are keys of a state store without a watermark, so a batch costs what it holds, whatever was accepted before, and a request that
    arrives late is still taken. ``known`` is put into the state once, at the start of the feed; known names that are added later
    are passed as a stream of their own.
    """
    asked = clean_requests(requests).select("username", "requested_at", F.lit(False).alias("is_known"))
    initial = None
    if known.isStreaming:
        names = known.select(normalise_name(F.col("username")).alias("username"), F.lit(None).cast("timestamp").alias("requested_at"), F.lit(True).alias("is_known"))
        asked = asked.unionByName(names.where("username IS NOT NULL"))
    else:
        initial = known.select("username").where("username IS NOT NULL").distinct().groupBy("username")
    asked = asked.mapInArrow(summed(["username"], {"requested_at": "min", "is_known": "any"}), "username string, requested_at timestamp, is_known boolean")
    fresh = asked.groupBy("username").transformWithState(NewNames(), "username string, requested_at timestamp", "Append", "None", initial)
    run_available(fresh, home, batch_writer(home))
    return written(requests.sparkSession, home).select("username", "requested_at")


def stream_scores(notices: DataFrame, posts: DataFrame, channels: DataFrame, audience: DataFrame, as_of: Column, home: str) -> DataFrame:
    """Continuous scoring: the channels named in a micro-batch go through the batch plan."""
    def score(batch: DataFrame) -> DataFrame:
        wanted = batch.select("channel_id").distinct()

        def of_batch(rows: DataFrame) -> DataFrame:
            return rows.join(wanted, "channel_id", "left_semi")

        scored = score_channels(of_batch(posts), of_batch(channels), of_batch(audience), as_of)
        return scored.select("channel_id", "username", "raw_score", "score", "verdict", "trust_factor", "status")

    run_available(notices, home, run_writer(home, ["channel_id"], score))
    return current(notices.sparkSession, home, ["channel_id"])
