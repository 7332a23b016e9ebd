"""Nearest neighbours by largest inner product, with a forest of hash prefixes.

1. Equal vectors (told by a 64-bit hash) are one: each distinct vector is indexed once with its ``top`` + 1 least ids, which is all a list of ``top`` can show of it, so a vector that
   a third of the rows share is cut to that many rows a task before the exchange.
2. Distinct vectors are dealt by their hash to blocks of about ``block`` vectors; each block is one task with a forest of its own. A vector, lifted by one
   coordinate so that the largest inner product is the smallest angle, gets a hash string of ``BITS`` signs of random directions for each of ``trees`` trees, and a
   tree is the sorted array of these strings.
3. The stated queries are sent to every block, in batches, so a task holds its block and one batch. A query descends in every tree to its longest
   matching prefixes, by binary search; then all trees are ascended together, one bit at a time, until they hold ``wanted`` candidates.
   All of these are scored in double precision, and each block gives the ``top`` + 1 best vectors. If fewer were found, the ascent goes on, up to the whole block.
4. ``wanted`` is fitted in each block: a bounded sample of queries (``SAMPLE``, the least by a hash of the row) is compared with the whole block, and the least number
   of candidates is taken with which the sample finds a share ``recall`` of its nearest rows. So the effort follows the data, and a
   table without structure is scanned as far as it takes. No bucket is cut off.
5. A query's lists from all blocks are merged, the ids of equal vectors are listed, the query's own row is left out.

Cost: the vectors are moved once, the queries once for each block. ``block`` bounds memory: rows * (8 * length + 16 * trees) bytes.

Results for odd input: rows without an id and those with a null, empty or zero vector or null or non-finite entries take no part; where vectors differ in length,
those of the commonest length do; rows equal in id and vector count as one, an id with several vectors as several rows; equal scores are ordered by id,
then by vector hash; with fewer candidates than ``top`` all are listed; an empty table, or one without queries, gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlens.llm.components import stored
from trustlens.llm.vectors import finite_vectors, matrix

TOP = 20
TREES = 32
BITS = 40
BLOCK = 1 << 14
SAMPLE = 64
RECALL = 0.95
SEED = 20240131
AT_ONCE = 256  # queries
FOUND = "query_id bigint, query_hash bigint, least_id bigint, vector_hash bigint, score double"
SENT = "block int, kind int, vec_id bigint, hash bigint, vector {}"


class Forest:
    """The trees over one block of vectors."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = SEED):
        self.vectors, length = vectors, vectors.shape[1]
        directions = np.random.default_rng(seed).standard_normal((trees * BITS, length + 1))
        for low in range(0, len(directions), length + 1):  # directions at right angles to each other tell more
            q, _ = np.linalg.qr(directions[low : low + length + 1].T)
            directions[low : low + q.shape[1]] = q.T
        self.directions, self.trees = directions.T.copy(), trees
        squares = np.einsum("ij,ij->i", vectors, vectors)
        codes = self.codes(vectors, np.sqrt(np.maximum(squares.max() - squares, 0)))
        self.order = np.argsort(codes, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(codes.T, self.order, 1)
        self.wanted = 1

    def codes(self, vectors: np.ndarray, lift: np.ndarray) -> np.ndarray:
        """Hash strings as numbers, a column a tree."""
        out = np.empty((len(vectors), self.trees), np.uint64)
        weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        for low in range(0, len(vectors), 1024):
            signs = np.column_stack([vectors[low : low + 1024], lift[low : low + 1024]]) @ self.directions > 0
            out[low : low + 1024] = (signs.reshape(-1, self.trees, BITS) * weights).sum(axis=2, dtype=np.uint64)
        return out

    def ranges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end in each tree of the strings that share the first 0 .. BITS bits with each query: [bits, tree, query]."""
        low, high = (np.empty((BITS + 1, self.trees, len(codes)), np.int64) for _ in range(2))
        for bits in range(BITS + 1):
            free = np.uint64(BITS - bits)
            first = (codes >> free) << free
            last = first + ((np.uint64(1) << free) - np.uint64(1))
            for t in range(self.trees):
                low[bits, t] = np.searchsorted(self.sorted[t], first[:, t], "left")
                high[bits, t] = np.searchsorted(self.sorted[t], last[:, t], "right")
        return low, high

    def fit(self, sample: np.ndarray, top: int, recall: float) -> None:
        """Take the least number of candidates, by powers of the square root of two, that finds the wanted share of the sample's nearest rows."""
        codes = self.codes(sample, np.zeros(len(sample)))
        low, high = self.ranges(codes)
        counts = (high - low).sum(axis=1)  # [bits, query]
        scores = sample @ self.vectors.T
        nearest = np.argsort(-scores, axis=1, kind="stable")[:, : top + 1]
        place = np.empty_like(self.order)
        np.put_along_axis(place, self.order, np.arange(self.order.shape[1])[None, :], 1)
        at = place[:, nearest]  # [tree, query, rank]
        shared = np.zeros(nearest.shape, np.int64)
        for bits in range(1, BITS + 1):
            shared[((low[bits][:, :, None] <= at) & (at < high[bits][:, :, None])).any(axis=0)] = bits
        for self.wanted in np.unique(np.round(2 ** np.arange(0, 0.5 + np.log2(self.order.size), 0.5)).astype(np.int64)).tolist():
            depth = (counts >= self.wanted).sum(axis=0) - 1  # counts fall with the number of bits
            if np.mean(shared >= depth[:, None]) >= recall:
                return
        self.wanted = self.order.size

    def search(self, queries: np.ndarray, top: int, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each query the places of the best vectors found and their scores; of equal scores the least ids stay."""
        codes = self.codes(queries, np.zeros(len(queries)))
        low, high = self.ranges(codes)
        depths = np.maximum(((high - low).sum(axis=1) >= self.wanted).sum(axis=0) - 1, 0)
        few = min(top + 1, len(self.vectors))
        mark = np.zeros(len(self.vectors), bool)
        for k, query in enumerate(queries):
            for bits in range(int(depths[k]), -1, -1):  # all trees ascend together
                for t in range(self.trees):
                    mark[self.order[t, low[bits, t, k] : high[bits, t, k]]] = True
                found = np.flatnonzero(mark)
                if len(found) >= few:
                    break
            mark[found] = False
            scores = self.vectors[found] @ query
            if len(found) > few:
                edge = np.partition(scores, len(found) - few)[len(found) - few]
                found, scores = found[scores >= edge], scores[scores >= edge]
                best = np.lexsort((ids[found], -scores))[:few]
                found, scores = found[best], scores[best]
            yield found, scores


def _searcher(length: int, sample: np.ndarray, top: int, trees: int, recall: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        now, forest, ids = None, None, None
        for whole in batches:
            blocks, kinds = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows], strict=True):
                if low == high:
                    continue
                batch = whole.slice(low, high - low)
                if now != blocks[low]:
                    now, forest, parts = blocks[low], None, []
                keys, vectors = (batch.column(2).to_numpy(), batch.column(3).to_numpy()), matrix(batch.column(4), length)
                if kinds[low] == 0:
                    parts.append((*keys, vectors))
                    continue
                if forest is None:
                    if not parts:
                        continue
                    ids = [np.concatenate([p[i] for p in parts]) for i in range(2)]
                    forest, parts = Forest(np.concatenate([p[2] for p in parts]).astype(np.float64), trees, seed), []
                    forest.fit(sample, top, recall)
                for at in range(0, len(vectors), AT_ONCE):
                    some = slice(at, at + AT_ONCE)
                    found = list(forest.search(vectors[some].astype(np.float64), top, ids[0]))
                    by = np.repeat(np.arange(len(found)), [len(f) for f, _ in found])
                    rows = np.concatenate([f for f, _ in found])
                    columns = [keys[0][some][by], keys[1][some][by], ids[0][rows], ids[1][rows], np.concatenate([s for _, s in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "query_hash", "least_id", "vector_hash", "score"])

    return run


def nearest(
    embeddings: DataFrame, is_query: Column, top: int = TOP, trees: int = TREES, block: int = BLOCK, recall: float = RECALL, seed: int = SEED, ids: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query row (a condition on ``vec_id``) the nearest other rows found."""
    spark = embeddings.sparkSession
    usable, length = finite_vectors(embeddings, ids, column)
    if not length:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = usable.where(F.col("vec_id").isNotNull() & F.exists("vector", lambda x: x != 0)).withColumn("hash", F.xxhash64("vector"))
    rows = stored(rows.dropDuplicates(["vec_id", "hash"]), "vectors")
    place = F.row_number().over(W.partitionBy("hash").orderBy("vec_id"))
    members = rows.select("hash", "vec_id").withColumn("place", place).where(F.col("place") <= top + 1).withColumnRenamed("hash", "vector_hash")
    first = members.where("place = 1").select("vec_id", F.col("vector_hash").alias("hash"))
    queries = rows.where(is_query)
    sample = [r[0] for r in queries.orderBy(F.xxhash64("vec_id", "hash"), "vec_id").limit(SAMPLE).select("vector").collect()]
    if not sample:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    blocks = max(1, -(-first.count() // block))
    kind = rows.schema["vector"].dataType.simpleString()
    indexed = rows.join(first, ["vec_id", "hash"]).select(F.pmod("hash", F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "hash", "vector")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "hash", "vector")
    dealt = indexed.unionByName(asked).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in SENT.format(kind).split(", ")])
    dealt = dealt.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind")
    found = dealt.mapInArrow(_searcher(length, np.array(sample, np.float64), top, trees, recall, seed), FOUND)
    query = W.partitionBy("query_id", "query_hash")
    merged = F.row_number().over(query.orderBy(F.desc("score"), "least_id", "vector_hash"))
    best = found.withColumn("r", merged).where(F.col("r") <= top + 1).drop("r", "least_id")
    listed = best.join(members, "vector_hash").where((F.col("vec_id") != F.col("query_id")) | (F.col("vector_hash") != F.col("query_hash")))
    ranked = listed.withColumn("rank", F.row_number().over(query.orderBy(F.desc("score"), "vec_id", "vector_hash")))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op11_hash_prefix_forest(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20."""
    return nearest(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
