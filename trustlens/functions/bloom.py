"""Bloom filters as small tables: which rows of a large table can have a partner at all, told before anything large is shuffled.

A filter is a table of blocks of 32,768 bits. A key has one block and ``2 * EACH`` bits in it, all from 64-bit hashes, so building is a grouped bitmap
aggregate over (block, hashes) and a test is a join on the block. There are ``BITS_A_KEY`` bits for each key, with which about 0.3 % of other keys pass. Filters of
more than ``MOST_BLOCKS`` blocks (4 KB each) aren't broadcast; the rows then stay as they are, and the join after the filter does all the work.
A filter never drops a row that has a partner, so what follows stays exact. Null keys have no partner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 15
EACH = 4  # positions in one 64-bit hash
BITS_A_KEY = 12
MOST_BLOCKS = 1 << 13


def blocks_for(keys: int) -> int:
    return max(1, -(-keys * BITS_A_KEY // BITS))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(salt), key) for salt in (1, 2)]


def _positions(hashes: list[Column]) -> list[Column]:
    return [F.shiftrightunsigned(h, 15 * j).bitwiseAND(F.lit(BITS - 1)) for h in hashes for j in range(EACH)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), key), F.lit(blocks))


def bloom_filter(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """filter block, filter words: each word holds 32 bits. Only hashes are shuffled, 24 bytes a key."""
    key = F.col(column)
    first, second = _hashes(key)
    hashed = keys.where(key.isNotNull()).select(_block(key, blocks).alias("filter block"), first.alias("a"), second.alias("b")).repartition("filter block")
    bits = hashed.select("filter block", F.explode(F.array(*_positions([F.col("a"), F.col("b")]))).alias("p"))
    words = F.transform(F.sequence(F.lit(0), F.lit(BITS // 32 - 1)), lambda i: F.conv(F.hex(F.substring(F.col("bits"), i * 4 + 1, F.lit(4))), 16, 10).cast("bigint"))
    return bits.groupBy("filter block").agg(F.bitmap_construct_agg("p").alias("bits")).select("filter block", words.alias("filter words"))


def _all_set(words: Column, key: Column) -> Column:
    found = F.lit(True)
    for p in _positions(_hashes(key)):
        place = (F.lit(3) - F.floor(p / 8) % 4) * 8 + p % 8  # bytes stand first to last in a word
        found = found & (F.getbit(F.element_at(words, (F.floor(p / 32) + 1).cast("int")), place.cast("int")) == 1)
    return found


def marked(rows: DataFrame, column: str, made: DataFrame, blocks: int, name: str) -> DataFrame:
    """The rows with a flag that is false only for keys that the filter surely doesn't hold."""
    joined = rows.withColumn("filter block", _block(F.col(column), blocks)).join(F.broadcast(made), "filter block", "left")
    hit = F.col("filter words").isNotNull() & F.col(column).isNotNull() & _all_set(F.col("filter words"), F.col(column))
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("filter block", "filter words")


def pruned(rows: DataFrame, column: str, keys: DataFrame, key: str, count: int) -> DataFrame:
    """The rows whose key can be one of ``count`` given keys; all of them where the filter would be too large to broadcast."""
    blocks = blocks_for(count)
    if blocks > MOST_BLOCKS:
        return rows
    return marked(rows, column, bloom_filter(keys, key, blocks), blocks, "may match").where("`may match`").drop("may match")
