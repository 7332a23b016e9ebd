"""Feeds: several micro-batches, restarts, late rows."""

from datetime import datetime

from pyspark.sql import functions as F

from trustlens.session import scratch_dir
from trustlens.streaming import feeds as S
from trustlens.streaming import runs as R


def source(spark, frames, name):
    path = scratch_dir(spark, name)
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path), path


def test_requests_late_and_repeated(spark, rows):
    schema = "username string, requested_at timestamp"
    frames = [
        rows([("@New1", datetime(2024, 5, 1)), ("known1", datetime(2024, 5, 1)), ("", datetime(2024, 5, 1))], schema),
        rows([("new1", datetime(2024, 5, 2)), ("late1", datetime(2020, 1, 1))], schema),
    ]
    home = scratch_dir(spark, "t-requests")
    stream, path = source(spark, frames, "t-requests-in")
    known = rows([("known1",)], "username string")
    assert {r["username"] for r in S.stream_requests(stream, known, home).collect()} == {"new1", "late1"}
    rows([("new1", datetime(2024, 5, 3)), ("more1", datetime(2024, 5, 3))], schema).coalesce(1).write.mode("append").parquet(path)
    got = [r["username"] for r in S.stream_requests(stream, known, home).collect()]
    assert sorted(got) == ["late1", "more1", "new1"]


def test_results_upsert_and_repeated_batch(spark, rows):
    schema = "username string, score int, scanned_at timestamp"
    frames = [rows([("@A1", 10, datetime(2024, 1, 1)), ("a1", 11, datetime(2024, 1, 2)), ("b1", 5, datetime(2024, 1, 1))], schema), rows([("a1", 30, datetime(2024, 1, 3))], schema)]
    home = scratch_dir(spark, "t-results")
    stream, _ = source(spark, frames, "t-results-in")
    current = S.stream_results(stream, home)
    assert {r["username"]: r["score"] for r in current.collect()} == {"a1": 30, "b1": 5}
    writer = S.batch_writer(home)
    writer(rows([("a1", 99, datetime(2024, 1, 4))], schema), 7)
    writer(rows([("a1", 99, datetime(2024, 1, 4))], schema), 7)
    again = S.written(spark, home)
    assert again.where("batch_id = 7").count() == 1


def test_usage_over_batches(spark, rows):
    schema = "event_id long, ts timestamp, event_type string, user_id long, duration_ms long"
    frames = [
        rows([(1, datetime(2024, 1, 1, 5), "app_open", 1, 10), (2, datetime(2024, 1, 1, 6), "app_open", 1, 20), (3, datetime(2024, 1, 1, 7), "channel_view", None, 30)], schema),
        rows([(4, datetime(2024, 1, 1, 8), "app_open", 1, 40), (5, datetime(2024, 1, 2, 1), "channel_detail", 2, 5)], schema),
    ]
    stream, _ = source(spark, frames, "t-usage-in")
    by_day = S.usage_by_day(S.stream_usage(stream, scratch_dir(spark, "t-usage")))
    got = {str(r["day"]): (r["events"], r["users"], r["avg_duration_ms"], r["opens"], r["browse"], r["detail"]) for r in by_day.collect()}
    assert got == {"2024-01-01": (4, 1, 25.0, 1, 0, 0), "2024-01-02": (1, 1, 5.0, 0, 0, 1)}


def test_usage_late_days_equal_the_batch(spark, rows):
    """Days out of order over several files, and a repeated batch: the sums are those of all rows at once."""
    schema = "event_id long, ts timestamp, event_type string, user_id long, duration_ms long"
    days = [(9, 1), (2, 1), (9, 2), (1, None), (5, 3), (2, 2)]
    frames = [
        rows([(10 * k + i, datetime(2024, 1, day, i), kind, user, None if i == 2 else 10 * k + i) for i, kind in enumerate(["app_open", "channel_view", "channel_detail"])], schema)
        for k, (day, user) in enumerate(days)
    ]
    stream, path = source(spark, frames, "t-usage-late-in")
    home = scratch_dir(spark, "t-usage-late")
    S.stream_usage(stream, home)
    rows([(100, datetime(2023, 12, 1), "app_open", 7, 5), (101, None, "app_open", 7, 5)], schema).coalesce(1).write.mode("append").parquet(path)
    counts = S.stream_usage(stream, home)
    everything = S.usage_counts(spark.read.schema(schema).parquet(path))
    listed = lambda frame: sorted(map(str, frame.select(*sorted(frame.columns)).collect()))
    assert listed(counts) == listed(everything) and counts.agg(F.sum("events")).first()[0] == 20
    assert listed(S.usage_by_day(counts)) == listed(S.usage_by_day(everything))


def test_late_rows_have_an_output_of_their_own(spark, rows):
    """Closed days are written once, later rows apart, open days stay in the state; a restart goes on from there."""
    schema = "event_id long, ts timestamp, event_type string, user_id long, duration_ms long"
    made = lambda k, day: rows([(k, datetime(2024, 1, day, 3), "app_open", 1, None), (k + 1, datetime(2024, 1, day, 4), "app_open", 1, 2**60), (k + 2, datetime(2024, 1, day, 23), "x", None, 7)], schema)
    stream, path = source(spark, [made(10 * k, day) for k, day in enumerate([3, 4, 8, 3, 9])], "t-late-in")
    home = scratch_dir(spark, "t-late")
    S.stream_usage(stream, home)
    listed = lambda frame: sorted(tuple(r) for r in frame.select("day", F.coalesce("user_id", F.lit(0)), "events", F.coalesce("duration_sum", F.lit(0))).groupBy("day").agg(F.sum("events").alias("n")).collect())
    late = {str(d): n for d, n in listed(S.late_usage(spark, home))}
    closed = {str(d): n for d, n in listed(S.written_usage(spark, home).where("NOT late"))}
    still_open = {str(r[0]): r[1] for r in S.state_rows(spark, home, "counts").groupBy("key.day").agg(F.sum("list_element.events")).collect()}
    assert (late, closed, still_open) == ({"2024-01-03": 3}, {"2024-01-03": 3, "2024-01-04": 3}, {"2024-01-08": 3, "2024-01-09": 3})
    made(90, 20).coalesce(1).write.mode("append").parquet(path)
    counts = S.stream_usage(stream, home)
    assert listed(S.written_usage(spark, home).where("NOT late"))[-1][1] == 3 and S.written_usage(spark, home).where("NOT late").select("day").distinct().count() == 4
    everything = S.usage_counts(spark.read.schema(schema).parquet(path))
    text = lambda frame: sorted(map(str, frame.select(*sorted(frame.columns)).collect()))
    assert text(counts) == text(everything)


def test_requests_with_a_stream_of_known_names(spark, rows):
    """Names that become known later are dropped from then on; in one batch a known name wins over its request."""
    schema = "username string, requested_at timestamp"
    stream, path = source(spark, [rows([("a1", datetime(2024, 1, 2)), ("@A1", datetime(2024, 1, 1)), ("b1", None)] + [("hot", datetime(2024, 1, 1))] * 50, schema)], "t-req-in")
    names, known_path = source(spark, [rows([("b1",)], "username string")], "t-known-in")
    home = scratch_dir(spark, "t-req")
    first = {r["username"]: r["requested_at"] for r in S.stream_requests(stream, names, home).collect()}
    assert first == {"a1": datetime(2024, 1, 1), "hot": datetime(2024, 1, 1)}
    rows([("@C1",), (None,)], "username string").coalesce(1).write.mode("append").parquet(known_path)
    S.stream_requests(stream, names, home)
    rows([("c1", datetime(2024, 1, 5)), ("a1", datetime(2024, 1, 6)), ("d1", datetime(2024, 1, 6))], schema).coalesce(1).write.mode("append").parquet(path)
    assert sorted(r["username"] for r in S.stream_requests(stream, names, home).collect()) == ["a1", "d1", "hot"]


def test_runs_are_merged_by_level(spark, rows):
    """Any number of batches leaves a few runs; a restart and a repeated batch change nothing."""
    schema, home = "k string, v int", scratch_dir(spark, "t-runs")
    wanted, most = {}, 0
    for k in range(14):
        write = R.run_writer(home, ["k"], fan=3)  # a new writer each time, as after a restart
        batch = rows([(f"key{(k * j) % 5}", 100 * k + j) for j in range(1, 2)] + [("same", k)], schema)
        write(batch, k)
        if k in (5, 8):  # a batch that merged two levels, repeated
            write(batch, k)
        wanted |= {f"key{k % 5}": 100 * k + 1, "same": k}
        most = max(most, len(R.runs(spark, home)))
        assert {r["k"]: r["v"] for r in R.current(spark, home, ["k"]).collect()} == wanted
    assert most <= 6 and [r["level"] for r in R.runs(spark, home)] == [2, 1, 0, 0]
    gone = R.drop_replaced(spark, home)
    assert len(gone) > 10 and {r["k"]: r["v"] for r in R.current(spark, home, ["k"]).collect()} == wanted
