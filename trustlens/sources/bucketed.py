"""Stored tables in buckets of their key, so that merges by key shuffle the patch and not the table.

A version of the table is a folder of bucketed Parquet files. A description beside the versions, written last, names the current one with its key, buckets and
schema, so any session opens it with its buckets known to the planner. A merge joins without an exchange of the table, and what it yields is dealt by
the key already, so the next version is written from the same tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _described(spark: SparkSession, home: str) -> dict:
    files, place = _files(spark, f"{home}/current.json")
    stream = files.open(place)
    try:
        return json.loads(bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode())
    finally:
        stream.close()


def _describe(spark: SparkSession, home: str, what: dict) -> None:
    files, place = _files(spark, f"{home}/current.json")
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/_{uuid.uuid4().hex}.json")
    out = files.create(aside, True)
    try:
        out.write(bytearray(json.dumps(what).encode()))
    finally:
        out.close()
    if files.exists(place):
        files.delete(place, False)
    files.rename(aside, place)


def store(rows: DataFrame, home: str, key: str, buckets: int) -> None:
    """Write the rows as a new version. ``buckets`` should be at least the number of shuffle partitions of the merges to come."""
    version = f"{home}/v-{uuid.uuid4().hex}"
    name = f"written_{uuid.uuid4().hex}"
    rows.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", version).saveAsTable(name)
    spark = rows.sparkSession
    spark.sql(f"DROP TABLE {name}")  # the files stay, the description below is what counts
    _describe(spark, home, {"version": version, "key": key, "buckets": buckets, "schema": rows.schema.json()})


def opened(spark: SparkSession, home: str) -> DataFrame:
    """The current version."""
    what = _described(spark, home)
    name = f"opened_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(what["schema"])))
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{what['key']}`) SORTED BY (`{what['key']}`) INTO {what['buckets']} BUCKETS LOCATION '{what['version']}'")
    return spark.table(name)


def merged(spark: SparkSession, home: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Replace the table by ``change`` of it, which keeps its key and columns (more may follow), and return the new version."""
    what = _described(spark, home)
    store(change(opened(spark, home)), home, what["key"], what["buckets"])
    return opened(spark, home)
