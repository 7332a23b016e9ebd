"""Token ids of all texts as fixed-length binary records in a global training order.

1. The documents are sorted by (doc_id, hash of the text) over range partitions, so that the order of the records is the same however
   the input is split; rows that agree in both are alike and take any order among themselves, so a very frequent one is spread. Every text
   is tokenised with a public byte-pair vocabulary (its path is a parameter; the driver reads it once and broadcasts it, at most
   ``MOST_VOCABULARY`` bytes) and cut into sequences of ``length`` ids: the ids of the text, an end id, and padding
   with the end id up to the fixed length. The records are written to the shared folder, so that they are numbered once and for all:
   a lost executor repeats single tasks of the write, never the numbering.
2. A sequence's number is its place in its task plus the sequences of earlier tasks (one row per task).
3. A keyed Feistel permutation over a * b >= N numbers, walked along its cycle until it lands below N, gives each number its own slot
   in 0 .. N - 1: a random order without a sort, computed for each row alone.
4. Shard k holds the slots from k * per_shard on, in order. Each record has the same stride, so the place of any slot is known: a run that
   stopped after slot s goes on at shard s // per_shard, byte (s % per_shard) * stride. The shards are written as raw files below the shared folder,
   in ``PASSES`` passes of a range of shards each, so that the disk holds the exchange of one pass only;
   the tasks that write them keep an index of the rows, and the records that are returned are read from the files.

Results for odd input: a null or empty text is one sequence that holds the end id only; rows that repeat a doc_id or have none give
sequences of their own; a very long text gives as many sequences as it needs; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.llm.components import settled
from trustlens.llm.packed import keyed
from trustlens.session import scratch_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_VOCABULARY = 64 << 20
LENGTH = 256
PER_SHARD = 1 << 15
KEY = 20240131
ROUNDS = 6
ROWS_AT_ONCE = 4096
PASSES = 3
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
INDEX = ["slot", "shard", "offset", "doc_id", "part", "n_tokens"]
MASK = (1 << 64) - 1


def _encoder(name: str, vocabulary: bytes):
    """The encoding, made once per Python worker."""
    import tiktoken
    from tiktoken import registry

    if name not in registry.ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        registry.ENCODINGS[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return registry.ENCODINGS[name]


def token_records(documents: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, end: int = END) -> DataFrame:
    """task, row, doc_id, part, n_tokens, record; ids are little-endian, of 2 bytes if all ids fit and else of 4."""
    with open(vocabulary, "rb") as file:
        data = file.read(MOST_VOCABULARY + 1)
    if len(data) > MOST_VOCABULARY:
        raise ValueError("the vocabulary is too large to broadcast")
    largest = max(end, max(int(line.split()[1]) for line in data.splitlines()))
    kind = "<u2" if largest < 1 << 16 else "<u4"
    sent = documents.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(f"records of {vocabulary}", sent.value).encode_ordinary
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, out, held = batch.column(0).to_pylist(), [], 0

            def made() -> pa.RecordBatch:
                nonlocal row
                n = len(out)
                row += n
                columns = [pa.array(np.full(n, task, np.int32)), pa.array(np.arange(row - n, row)), *(pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary())))]
                return pa.RecordBatch.from_arrays(columns, ["task", "row", "doc_id", "part", "n_tokens", "record"])

            for doc, text in zip(ids, batch.column(1), strict=True):
                tokens = np.array([*encode(text.as_py() or ""), end], kind)
                parts = -(-len(tokens) // length)
                padded = np.full(parts * length, end, kind)
                padded[: len(tokens)] = tokens
                out += [(doc, p, min(length, len(tokens) - p * length), padded[p * length : (p + 1) * length].tobytes()) for p in range(parts)]
                if len(out) >= ROWS_AT_ONCE:
                    yield made()
                    out = []
            if out:
                yield made()

    texts = keyed(documents).withColumn("at", F.monotonically_increasing_id())
    order = ["doc_id", "text_key", "at"]
    ordered = texts.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return ordered.mapInArrow(run, "task int, row bigint, doc_id bigint, part int, n_tokens int, record binary")


def feistel(numbers: np.ndarray, size: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """The place of each number below size in a keyed permutation of all of them."""
    a = max(1, math.isqrt(max(size - 1, 0)) + 1)
    b = max(1, -(-size // a))

    def scramble(half: np.ndarray, k: int) -> np.ndarray:
        x = half.astype(np.uint64) + np.uint64((key * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & MASK)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    out, todo = numbers.astype(np.int64).copy(), np.arange(len(numbers))
    while len(todo):
        left, right = out[todo] // b, out[todo] % b
        for k in range(rounds):
            if k % 2:
                right = (right + (scramble(left, k) % np.uint64(b)).astype(np.int64)) % b
            else:
                left = (left + (scramble(right, k) % np.uint64(a)).astype(np.int64)) % a
        out[todo] = left * b + right
        todo = todo[out[todo] >= size]  # walk on: the cycle leads back below size
    return out


def numbered(records: DataFrame) -> tuple[DataFrame, int]:
    """The records with their global number, and how many there are. The counts have one row per task of the write."""
    spark = records.sparkSession
    counts = sorted((r[0], r[1]) for r in records.groupBy("task").agg(F.count("*")).collect())
    starts, total = [], 0
    for task, n in counts:
        starts.append((task, total))
        total += n
    table = spark.createDataFrame(starts, "task int, start bigint")
    return records.join(F.broadcast(table), "task").withColumn("number", F.col("start") + F.col("row")).drop("start"), total


def placed(documents: DataFrame, vocabulary: str, length: int, end: int, per_shard: int, key: int) -> tuple[DataFrame, int]:
    """slot, shard, offset, doc_id, part, n_tokens, record in no order, and how many there are."""
    rows, total = numbered(settled(token_records(documents, vocabulary, length, end), "records", compression="zstd"))

    @F.pandas_udf("bigint")
    def slot(numbers: pd.Series) -> pd.Series:
        return pd.Series(feistel(numbers.to_numpy(), total, key))

    shard = F.floor(F.col("slot") / F.lit(per_shard)).cast("int")
    slots = rows.select(slot("number").alias("slot"), "doc_id", "part", "n_tokens", "record")
    return slots.select("slot", shard.alias("shard"), ((F.col("slot") % F.lit(per_shard)) * F.octet_length("record")).alias("offset"), "doc_id", "part", "n_tokens", "record"), total


def training_order(documents: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, end: int = END, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """slot, shard, offset, doc_id, part, n_tokens, record; partition k holds shard k in the order of its slots."""
    rows, total = placed(documents, vocabulary, length, end, per_shard, key)
    return rows.repartitionById(max(1, -(-total // per_shard)), F.col("shard")).sortWithinPartitions("slot")


def _written(batches: Iterator[pa.RecordBatch], uri: str, made: list[list]) -> Iterator[pa.RecordBatch]:
    """The batches, each after its records have gone to their shards; ``made`` gets shard, path, first slot, records and bytes of each shard."""
    system, root = pyarrow.fs.FileSystem.from_uri(uri)
    system.create_dir(root, recursive=True)
    file, shard, attempt = None, None, TaskContext.get().taskAttemptId()

    def close() -> None:
        file.close()
        system.move(f"{root}/.{shard:06d}.{attempt}", made[-1][1])

    for batch in batches:
        shards, slots = batch.column(1).to_numpy(), batch.column(0).to_numpy()
        for at in np.flatnonzero(np.append(True, shards[1:] != shards[:-1])).tolist() if len(shards) else ():
            if shard != shards[at]:
                if file:
                    close()
                shard = int(shards[at])
                file = system.open_output_stream(f"{root}/.{shard:06d}.{attempt}")
                made.append([shard, f"{root}/{shard:06d}.bin", int(slots[at]), 0, 0])
            records = batch.column(6).filter(pa.array(shards == shard)).to_pylist()
            data = b"".join(records)
            file.write(data)
            made[-1][3] += len(records)
            made[-1][4] += len(data)
        yield batch
    if file:
        close()


def write_shards(ordered: DataFrame, uri: str) -> DataFrame:
    """One raw file per shard in a shared folder (any file system that Arrow knows by its URI); a repeated task writes the same file again.

    Returns shard, path, first slot, records, bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[list] = []
        for _ in _written(batches, uri, made):
            pass
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["shard", "path", "first_slot", "records", "bytes"])

    return ordered.mapInArrow(run, "shard int, path string, first_slot bigint, records bigint, bytes bigint")


def shared_uri(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared one as a URI that Spark and Arrow read alike, whatever Spark's default file system is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark, purpose))
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


def sharded_order(
    documents: DataFrame, uri: str | None = None, vocabulary: str = VOCABULARY, length: int = LENGTH, end: int = END, per_shard: int = PER_SHARD, key: int = KEY
) -> DataFrame:
    """slot, shard, offset, doc_id, part, n_tokens, record, path of all records, once their shards are written below uri (else the shared folder)."""
    uri = shared_uri(documents.sparkSession, "shards") if uri is None else uri

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _written(batches, uri, []):
            stride = pc.cast(pc.binary_length(batch.column(6)), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], stride], [*INDEX, "stride"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pyarrow.fs.FileSystem.from_uri(uri)
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(low, ROWS_AT_ONCE)
                shards, offsets, strides = (batch.column(i).to_numpy() for i in (1, 2, 6))
                follows = (shards[1:] == shards[:-1]) & (offsets[1:] == offsets[:-1] + strides[:-1])  # read by one call
                records: list[bytes] = []
                for rows in np.split(np.arange(len(shards)), np.flatnonzero(~follows) + 1):
                    with system.open_input_file(f"{root}/{shards[rows[0]]:06d}.bin") as file:
                        data = file.read_at(int(strides[rows].sum()), int(offsets[rows[0]]))
                    records += [data[b : b + n] for b, n in zip((offsets[rows] - offsets[rows[0]]).tolist(), strides[rows].tolist(), strict=True)]
                paths = [f"{root}/{s:06d}.bin" for s in shards.tolist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(records, pa.binary()), pa.array(paths, pa.string())], [*INDEX, "record", "path"])

    kinds = "slot bigint, shard int, offset bigint, doc_id bigint, part int, n_tokens int"
    rows, total = placed(documents, vocabulary, length, end, per_shard, key)
    shards, index, spark = max(1, -(-total // per_shard)), scratch_dir(documents.sparkSession, "index"), documents.sparkSession
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        step = -(-shards // PASSES)
        for low in range(0, shards, step):
            count = min(step, shards - low)
            some = rows if count == shards else rows.where(F.col("shard").between(low, low + count - 1))
            some = some.repartitionById(count, F.col("shard") - F.lit(low)).sortWithinPartitions("slot")
            some.mapInArrow(write, f"{kinds}, stride int").write.mode("append").parquet(index)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(f"{kinds}, stride int").parquet(index).mapInArrow(read, f"{kinds}, record binary, path string")


def read_slots(uri: str, start: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD, kind: str = "<u2") -> np.ndarray:
    """``count`` records from slot ``start`` on, read one shard after another by their places alone."""
    system, root = pyarrow.fs.FileSystem.from_uri(uri)
    stride, out = length * np.dtype(kind).itemsize, []
    while count > 0:
        shard, at = divmod(start, per_shard)
        with system.open_input_file(f"{root}/{shard:06d}.bin") as file:
            file.seek(at * stride)
            data = file.read(min(count, per_shard - at) * stride)
        if not data:
            break
        out.append(np.frombuffer(data, kind).reshape(-1, length))
        start, count = start + len(out[-1]), count - len(out[-1])
    return np.concatenate(out) if out else np.zeros((0, length), kind)


def op10_training_order(spark: SparkSession, folder: str) -> DataFrame:
    return sharded_order(spark.read.parquet(f"{folder}/documents.parquet"))
