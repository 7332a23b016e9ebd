"""Tables kept as runs: each micro-batch adds one, and runs of one level are merged into one of the next when there are enough of them.

A run is a folder with at most one row per key and the number of the batch each row came in. A manifest per batch, written last, lists the runs that
make up the table, so readers never see a half-written run, and a repeated batch starts from the manifest before it and writes the same
again. Reading meets at most ``FAN - 1`` runs of each level: their number grows with the logarithm of the number of batches.
All files are reached through Spark's file systems.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.operators.lifecycle import latest_by_key

BATCH = "batch_id"
FAN = 8


def _files(spark: SparkSession, path: str):
    """The file system of a path and the path as it names it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _manifests(spark: SparkSession, home: str) -> dict[int, str]:
    files, folder = _files(spark, f"{home}/manifest")
    listed = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return {int(n.split(".")[0]): f"{home}/manifest/{n}" for n in listed if n.endswith(".json") and not n.startswith((".", "_"))}


def runs(spark: SparkSession, home: str, before: int | None = None) -> list[dict]:
    """The runs of the newest manifest, or of the newest before a batch: level, folder, rows' last batch."""
    found = {k: p for k, p in _manifests(spark, home).items() if before is None or k < before}
    if not found:
        return []
    files, place = _files(spark, found[max(found)])
    stream = files.open(place)
    try:
        text = spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)
    finally:
        stream.close()
    return json.loads(bytes(text).decode())


def _write_manifest(spark: SparkSession, home: str, batch_id: int, listed: list[dict]) -> None:
    """Written aside and renamed, so that it appears whole."""
    files, place = _files(spark, f"{home}/manifest/{batch_id:012d}.json")
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/manifest/_{batch_id:012d}.part")
    out = files.create(aside, True)
    try:
        out.write(bytearray(json.dumps(listed).encode()))
    finally:
        out.close()
    if files.exists(place):
        files.delete(place, False)
    files.rename(aside, place)


def _read(spark: SparkSession, home: str, some: list[dict], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{home}/runs/{r['folder']}" for r in some])


def run_writer(home: str, keys: list[str], transform: Callable[[DataFrame], DataFrame] | None = None, fan: int = FAN) -> Callable[[DataFrame, int], None]:
    """A sink that adds each batch as a run and merges full levels; ``transform`` leaves at most one row per key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = (transform(batch) if transform else batch).withColumn(BATCH, F.lit(batch_id).cast("bigint"))
        listed = runs(spark, home, batch_id) + [{"level": 0, "folder": f"0-{batch_id:012d}", "batch": batch_id}]
        rows.write.mode("overwrite").parquet(f"{home}/runs/{listed[-1]['folder']}")
        level = 0
        while len(full := [r for r in listed if r["level"] == level]) >= fan:
            merged = {"level": level + 1, "folder": f"{level + 1}-{batch_id:012d}", "batch": batch_id}
            latest_by_key(_read(spark, home, full, rows.schema), keys, [BATCH]).select(*rows.columns).write.mode("overwrite").parquet(f"{home}/runs/{merged['folder']}")
            listed = [r for r in listed if r["level"] != level] + [merged]
            level += 1
        _write_manifest(spark, home, batch_id, listed)

    return write


def current(spark: SparkSession, home: str, keys: list[str]) -> DataFrame:
    """The newest row of each key."""
    listed = runs(spark, home)
    if not listed:
        raise ValueError(f"no run below {home}")
    schema = spark.read.parquet(f"{home}/runs/{listed[-1]['folder']}").schema
    return latest_by_key(_read(spark, home, listed, schema), keys, [BATCH]).drop(BATCH)


def drop_replaced(spark: SparkSession, home: str, keep: int = 2) -> list[str]:
    """Delete the runs that none of the newest ``keep`` manifests lists, and the older manifests; readers of those have ended by then."""
    manifests = _manifests(spark, home)
    newest = sorted(manifests)[-keep:]
    live = {r["folder"] for k in newest for r in runs(spark, home, k + 1)}
    files, folder = _files(spark, f"{home}/runs")
    gone = [s.getPath().getName() for s in files.listStatus(folder) if s.getPath().getName() not in live]
    for name in gone:
        files.delete(_files(spark, f"{home}/runs/{name}")[1], True)
    for k in sorted(manifests)[:-keep]:
        files.delete(_files(spark, manifests[k])[1], False)
    return gone
