"""Structures that are built once and read often: cells of pages, buckets of keys, daily sketches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trustlens.operators import lifecycle as L
from trustlens.operators import page_index as P
from trustlens.operators import usage_sketches as SK
from trustlens.session import scratch_dir
from trustlens.sources import bucketed


def listing(spark, n=20_000):
    """Names with few different scores, one of them on a third of the rows, and nulls."""
    score = F.when(F.col("id") % 3 == 0, F.lit(50)).when(F.col("id") % 101 != 0, (F.col("id") * 37) % 90)
    return spark.range(n).repartition(6).select(F.concat(F.lit("c"), (F.col("id") * 7919) % n).alias("username"), score.cast("int").alias("score"), F.col("id").alias("members"))


@pytest.mark.parametrize("sort_by, descending", [("score", True), ("score", False), ("members", True), ("unknown", True)])
def test_pages_equal_offsets_and_read_few_cells(spark, sort_by, descending):
    rows, home = listing(spark), scratch_dir(spark, "t-pages")
    P.build_page_index(rows, home, sort_by, descending, cell_rows=500)
    key = lambda r: (r["members"] if sort_by == "members" else r["score"])
    ordered = sorted(rows.collect(), key=lambda r: ((key(r) is None) == descending, (-key(r) if descending else key(r)) if key(r) is not None else 0, r["username"]))
    files = spark.read.parquet(f"{home}/cells").inputFiles()
    for page in (1, 2, 17, 100, 399, 400, 401, 10_000):
        got = P.indexed_page(spark, home, page, 50)
        assert [r["username"] for r in got.collect()] == [r["username"] for r in ordered[(page - 1) * 50 : page * 50]], page
        assert all(r["total"] == 20_000 and r["has_more"] == (page < 400) for r in got.collect())
    plan = P.indexed_page(spark, home, 300, 50)._jdf.queryExecution().executedPlan().toString()
    cells = len(plan.split(f"{P.CELL}#")[0]) and spark.read.parquet(f"{home}/index").where("start < 15000 AND start + rows > 14950").count()
    assert len(files) > 30 and cells <= 2 and "PartitionFilters" in plan
    empty = scratch_dir(spark, "t-pages")
    P.build_page_index(rows.limit(0), empty)
    assert P.indexed_page(spark, empty, 3).count() == 0


def exchanges_above_scan(plan: str, folder: str) -> bool:
    """Whether a scan of the folder stands below an exchange, by the indentation of the plan's text."""
    open_at, found = [], False
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        while open_at and open_at[-1] >= depth:
            open_at.pop()
        if "Exchange" in line:
            open_at.append(depth)
        if "FileScan" in line and folder in line and open_at:
            found = True
    return found


def test_merges_do_not_shuffle_the_stored_side(spark, rows):
    home = scratch_dir(spark, "t-bucketed")
    stored = spark.range(5000).select(
        F.concat(F.lit("n"), "id").alias("username"), F.when(F.col("id") % 2 == 0, "WAITING").otherwise("GOOD").alias("status"), (F.col("id") % 100).cast("int").alias("score"),
        F.lit("OLD").alias("category"), F.lit(datetime(2024, 1, 1)).alias("scanned_at"),
    )
    bucketed.store(stored, home, "username", 8)
    patch = spark.range(0, 5000, 3).select(F.concat(F.lit("n"), "id").alias("username"), F.lit(7).alias("score"), F.when(F.col("id") % 2 == 0, F.lit("NEW")).alias("category"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        as_of = F.lit(datetime(2024, 2, 1))
        change = L.patch_rows(bucketed.opened(spark, home), patch, as_of)
        plan = change._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and not exchanges_above_scan(plan, "t-bucketed")
        assert exchanges_above_scan(L.patch_rows(stored.transform(lambda f: _plainly(spark, f)), patch, as_of)._jdf.queryExecution().executedPlan().toString(), "t-plain")
        finished = L.complete_waiting(bucketed.opened(spark, home), patch.withColumn("status", F.lit("GOOD")), ["status", "score"], ["category"])
        assert not exchanges_above_scan(finished._jdf.queryExecution().executedPlan().toString(), "t-bucketed")
        after = bucketed.merged(spark, home, lambda rows: L.patch_rows(rows, patch, as_of))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = {r["username"]: (r["score"], r["category"], r["patched"]) for r in after.collect()}
    assert got == {f"n{k}": (7 if k % 3 == 0 else k % 100, "NEW" if k % 6 == 0 else "OLD", k % 3 == 0) for k in range(5000)}
    again = bucketed.merged(spark, home, lambda rows: rows.where("score <> 7"))  # the next version starts from this one
    assert again.count() == sum(v[0] != 7 for v in got.values()) and bucketed.opened(spark, home).count() == again.count()


def _plainly(spark, frame):
    path = scratch_dir(spark, "t-plain")
    frame.write.parquet(path)
    return spark.read.parquet(path)


def events(rows, seed, n, users, days=12):
    rng = random.Random(seed)
    kinds = ["app_open", "search_submit", "channel_view", "channel_detail", "scan_request"]
    start = datetime(2024, 1, 1)
    data = [(start + timedelta(days=rng.randrange(days), minutes=rng.randrange(1440)), rng.choice(kinds), rng.choice([None, *range(users)]) if k % 3 else 7) for k in range(n)]
    return data, rows([*data, (None, "app_open", 1)], "ts timestamp, event_type string, user_id long")


def test_sketches_of_parts_in_any_order(rows, spark):
    """Loads out of order, one of them twice: small numbers are exact."""
    data, frame = events(rows, 1, 4000, 300)
    folder = scratch_dir(spark, "t-sketches")
    for low, high in ((5, 9), (0, 6), (8, 12), (5, 9)):
        SK.merge_events(frame.where(F.dayofmonth("ts").between(low + 1, high)), folder)
    found = {(str(r["day"]), r["stage"]): (r["users"], r["estimate"]) for r in SK.measured(SK.rolling_estimates(SK.read_sketches(spark, folder), 3), SK.rolling_exact(frame, 3)).collect()}
    stages = {"users": None, **SK.FUNNEL}
    for (day, stage), (users, estimate) in found.items():
        last = datetime.fromisoformat(day) + timedelta(days=1)
        wanted = {u for ts, kind, u in data if u is not None and last - timedelta(days=3) <= ts < last and (stages[stage] is None or kind in stages[stage])}
        assert users == estimate == len(wanted)
    assert len(found) == 48


def test_error_of_large_sketches(spark):
    """Beyond the sketch's entries the error stays within its bound."""
    frame = spark.range(400_000).select((F.lit(datetime(2024, 1, 1)) + F.make_dt_interval((F.col("id") % 9).cast("int"))).alias("ts"), F.lit("app_open").alias("event_type"), ((F.col("id") * 48271) % 150_000).alias("user_id"))
    measured = SK.measured(SK.rolling_estimates(SK.daily_sketches(frame), 7), SK.rolling_exact(frame, 7)).agg(F.max("error"), F.max("users"), F.count("*")).first()
    assert measured[0] < 0.03 and measured[1] > 100_000 and measured[2] == 18
