"""Texts packed for a shuffle: whole-text joins move about half of what Spark's own block compression would."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlens.llm.flat import text_rows

KEYED = "doc_id bigint, text_key bigint"


def text_key() -> Column:
    """With doc_id the key of a row; rows that agree in both hold the same text and get the same result."""
    return F.xxhash64("text").alias("text_key")


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, text; any other columns, whatever their names, are left behind."""
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(), F.col("text").cast("string").alias("text"))


def press_texts(column: pa.Array) -> pa.Array:
    """Each text packed (null for null)."""
    press = zstandard.ZstdCompressor(level=3)
    data, offsets = text_rows(column)
    raw, at, there = memoryview(data), offsets.tolist(), column.is_valid().to_pylist()
    return pa.array([press.compress(raw[a:b]) if ok else None for a, b, ok in zip(at, at[1:], there, strict=False)], pa.binary())


def pack(texts: DataFrame) -> DataFrame:
    """doc_id, text_key, packed (null for null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), press_texts(batch.column(2))], ["doc_id", "text_key", "packed"])

    return texts.mapInArrow(run, f"{KEYED}, packed binary")


def unpack(column: pa.Array) -> list[bytes]:
    """Null is the empty text."""
    press = zstandard.ZstdDecompressor()
    return [b"" if x is None else press.decompress(x) for x in column.to_pylist()]


def flatten(texts: list[bytes]) -> pa.Array:
    return pa.array(texts, pa.large_binary())
