"""Connected components of a table of links: contracted within partitions, as few as their number allows, then by alternating large-star and small-star steps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.session import scratch_dir

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LINKS_HELD = 1 << 20  # of a partition, contracted at a time
LINKS_A_TASK = 1 << 18  # where partitions are merged before they are contracted again, 4 MB


def stored(frame: DataFrame, purpose: str, **options: str) -> DataFrame:
    """The frame written to the shared folder and read again: its lineage ends there and lost executors cost nothing."""
    path = scratch_dir(frame.sparkSession, f"{purpose}-{uuid.uuid4().hex[:8]}")
    frame.write.options(**options).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each action inside are removed when it ends; what is kept is written."""
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def settled(frame: DataFrame, purpose: str, **options: str) -> DataFrame:
    """``stored``, and the shuffle files that the frame was made from are removed once it is written."""
    with shuffles_removed(frame.sparkSession):
        return stored(frame, purpose, **options)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some links but the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low < high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[rest], nodes[root[rest]]


def contracted(links: DataFrame, most: int = LINKS_HELD) -> DataFrame:
    """Links that connect the same nodes, at most one a node of each partition; a task holds about ``most`` of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def made(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(x) for x, _ in held) > most:
                held = [forest(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                if len(held[0][0]) > most // 2:
                    yield made(*held.pop())
        if held:
            yield made(*forest(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return links.mapInArrow(run, "a bigint, b bigint")


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Does every node have one link upwards at most, and no node that others link to any?"""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    ways = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    with shuffles_removed(links.sparkSession):
        return ways.where("up > 1 or up = 1 and least = 0").isEmpty()


def components(spark: SparkSession, links: DataFrame, a_task: int = LINKS_A_TASK) -> DataFrame:
    """node, component (the least node reachable) of every node that has a link; links has bigint columns a and b.

    The links of each partition are first contracted to a forest, which leaves few of them. What is left is contracted again by tasks of about
    ``a_task`` links; where that is one task, nothing is open. Else each further step is two grouped minima with
    partial aggregation, so a node with very many links is no hot group, and the same contraction of what they give. The number of steps
    grows with the logarithm of the longest chain at most.
    """
    links = settled(contracted(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "links")
    while True:
        tasks = -(-links.count() // a_task)
        links = settled(contracted(links.coalesce(max(1, tasks))), "links")
        if tasks <= 1 or _is_forest_of_stars(links):
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour is linked to the least of the neighbourhood
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: the node and its smaller neighbours are linked to the least of them
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        links = settled(contracted(small.where("a <> b").distinct()), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
