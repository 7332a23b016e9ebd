"""Keyed upserts, queues and caches as joins of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlens.functions.scalars import normalise_name, valid_name
from trustlens.session import ensure_checkpoint_dir


def latest_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key. Partial aggregation keeps a frequent key from crowding one task."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, "newest.*")


def newest_per_user(favorites: DataFrame, keep: int) -> DataFrame:
    window = W.partitionBy("user_id").orderBy(F.col("added_at").desc(), F.col("seq").desc())
    return favorites.withColumn("position", F.row_number().over(window)).where(F.col("position") <= keep)


def queue_positions(rows: DataFrame, *order: str) -> DataFrame:
    """Exact position of every row in a global order, without sorting everything in one task.

    Rows are range-partitioned and sorted; each row takes its place within its partition
    plus the number of rows in earlier partitions. The sorted rows are checkpointed, so the
    partition bounds cannot change between the two uses. Only one row per partition is
    ever ordered centrally.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
    ).checkpoint()
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(
        "position", F.col("_start") + F.col("_place") + 1
    ).drop("_part", "_place", "_start")


def new_names(known: DataFrame, candidates: DataFrame) -> DataFrame:
    """Names not yet known, once each, with the smallest of their origins."""
    names = candidates.withColumn("username", normalise_name(F.col("username"))).groupBy("username").agg(
        F.min("found_via").alias("found_via")
    )
    return names.join(known.select("username"), "username", "left_anti")


def seeds(names: DataFrame) -> DataFrame:
    return names.select("username").withColumn("found_via", F.lit("[seed]"))


def relabel_requested(results: DataFrame, requested: DataFrame) -> DataFrame:
    """Waiting rows somebody asked for become user requests; all other rows stay as they are."""
    asked = requested.select(normalise_name(F.col("username")).alias("username")).distinct().withColumn("asked", F.lit(True))
    hit = F.coalesce(F.col("asked"), F.lit(False)) & (F.col("status") == "WAITING")
    return results.join(asked, "username", "left").withColumn(
        "found_via", F.when(hit, F.lit("user_request")).otherwise(F.col("found_via"))
    ).drop("asked")


def not_skipped(names: DataFrame, skip_list: DataFrame, as_of: Column) -> DataFrame:
    active = skip_list.where(F.col("expires_at") > as_of).select("username")
    return names.join(active, "username", "left_anti")


def skipped_until(skip_list: DataFrame, names: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Skip list after adding names for some days and purging what has expired."""
    added = names.select("username", (as_of + F.make_dt_interval(F.lit(days))).alias("expires_at"), F.lit(1).alias("fresh"))
    both = skip_list.select("username", "expires_at", F.lit(0).alias("fresh")).unionByName(added)
    newest = latest_by_key(both, ["username"], ["fresh", "expires_at"])
    return newest.where(F.col("expires_at") > as_of).select("username", "expires_at")


def one_per_name(rows: DataFrame) -> DataFrame:
    """One row per name: the one scanned last, where that is known, and of equal ones the greatest as JSON text."""
    values = [c for c in rows.columns if c != "username"]
    if not values:
        return rows.distinct()
    order = [*[F.col(c) for c in ("scanned_at",) if c in values], F.to_json(F.struct(*values))]
    return rows.groupBy("username").agg(F.max_by(F.struct(*values), F.struct(*order)).alias("row")).select("username", "row.*")


def complete_waiting(results: DataFrame, scored: DataFrame, keep: list[str], fill: list[str]) -> DataFrame:
    """Write new values into rows that still wait.

    ``keep`` columns are overwritten; ``fill`` columns fall back to the stored value where
    the new one is missing. Rows in any other state are left untouched.
    """
    new = one_per_name(scored.select("username", *keep, *fill))
    fresh = new.select("username", *[F.col(c).alias(f"new_{c}") for c in [*keep, *fill]], F.lit(True).alias("has_new"))
    joined = results.join(fresh, "username", "left")
    write = (F.col("status") == "WAITING") & F.coalesce(F.col("has_new"), F.lit(False))
    written = {c: F.when(write, F.col(f"new_{c}")).otherwise(F.col(c)) for c in keep}
    filled = {c: F.when(write, F.coalesce(F.col(f"new_{c}"), F.col(c))).otherwise(F.col(c)) for c in fill}
    return joined.withColumn("written", write).withColumns({**written, **filled}).select(*results.columns, "written")


# Field names and the columns they are stored in
RENAMED = {
    "breakdown": "breakdown_json",
    "trust_penalties": "trust_penalties_json",
    "conviction_factors": "conviction_factors_json",
    "forensics": "forensics_json",
    "safety": "safety_json",
    "posts_raw": "posts_raw_json",
    "user_ids": "user_ids_json",
}


def patch_rows(results: DataFrame, patch: DataFrame, as_of: Column, coalesced: tuple[str, ...] = ("category", "category_secondary")) -> DataFrame:
    """Partial update by key: patched columns replace stored ones, label columns only where given, and the row is stamped."""
    renamed = one_per_name(patch).withColumnsRenamed({k: v for k, v in RENAMED.items() if k in patch.columns})
    columns = [c for c in renamed.columns if c != "username"]
    fresh = renamed.select("username", *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("patched"))
    joined = results.join(fresh, "username", "left")
    hit = F.coalesce(F.col("patched"), F.lit(False))
    values = {}
    for c in columns:
        new = F.col(f"new_{c}")
        stored = F.col(c) if c in results.columns else F.lit(None)
        values[c] = F.when(hit, F.coalesce(new, stored) if c in coalesced else new).otherwise(stored)
    values["scanned_at"] = F.when(hit, as_of).otherwise(F.col("scanned_at"))
    kept = list(dict.fromkeys([*results.columns, *columns]))
    return joined.withColumns(values).select(*kept, hit.alias("patched"))


def cached_answers(keys: DataFrame, cache: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """The newest answer per key that is still valid; keys without one come back as misses."""
    valid = cache.where(F.col("cached_at") > as_of - F.make_dt_interval(F.lit(days)))
    newest = latest_by_key(valid, ["key"], ["cached_at", "turn"])
    return keys.join(newest, "key", "left").withColumn("hit", F.col("cached_at").isNotNull())


def triage(requests: DataFrame, results: DataFrame, queue: DataFrame) -> DataFrame:
    """What to answer to each requested name: already scored, already queued (with place), new, or invalid."""
    names = requests.select(normalise_name(F.col("username")).alias("username")).distinct()
    scored = results.where(F.col("status").isin("GOOD", "BAD") & (F.col("score") > 0)).select("username", F.lit(True).alias("scored"))
    queued = queue.select("username", F.col("position").alias("queue_position"))
    joined = names.join(scored, "username", "left").join(queued, "username", "left")
    answer = (
        F.when(~valid_name(F.col("username")), "invalid").when(F.col("scored"), "scored")
        .when(F.col("queue_position").isNotNull(), "queued").otherwise("new")
    )
    return joined.select("username", answer.alias("answer"), F.when(F.col("scored").isNull(), F.col("queue_position")).alias("queue_position"))


def remove_keys(rows: DataFrame, tombstones: DataFrame, keys: list[str], only_waiting: bool = False) -> DataFrame:
    """Rows left after deleting the given keys, optionally only where they still wait."""
    gone = tombstones.select(*keys).distinct()
    if not only_waiting:
        return rows.join(gone, keys, "left_anti")
    doomed = rows.where(F.col("status") == "WAITING").join(gone, keys, "left_semi").select(*keys)
    return rows.join(doomed, keys, "left_anti")
