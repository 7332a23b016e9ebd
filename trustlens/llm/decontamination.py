"""Documents that hold passages of benchmark items, by winnowed fingerprints.

Texts are lower-cased (A-Z) and cut into words of digits, letters and non-ASCII characters. A window is ``window`` consecutive words
of an item; an item with fewer words, but not none, is one window. Of every window the least hash of its ``gram``-word grams is kept,
on both sides, so each shared window shares a fingerprint. The windows around a shared fingerprint are compared whole with the distinct
windows of the items, and hits that overlap or follow each other are extended to one span. As only distinct windows are held, a run of
equal words is one window on the side of the items and one look-up a word on the other, however often it occurs. Items shorter than a window are looked up whole.

The benchmark is read in blocks of ``block_bytes`` of text, each of which is broadcast; the documents stream past every block
with the hits found so far, so nothing is shuffled and memory does not follow either table.

Results for odd input: null, empty or wordless texts have no words and no hits; an item without id or words is no item; rows that repeat an
item_id are parts of one item; every row of documents gives one row, whatever its doc_id; an empty benchmark hits nothing; other columns
of either table are ignored or, in ``decontaminate``, kept as they are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlens.llm.flat import ALNUM_WORDS, LOWER, pieces, sliding_argmin, text_rows, window_hashes, window_starts, word_hashes, word_spans

WINDOW = 13
GRAM = 6
BLOCK_BYTES = 4 << 20
AT_ONCE = 1 << 20

RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def _fingerprints(words: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the grams that are least in some window."""
    starts, _ = window_starts(first, window)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = window_hashes(words, np.arange(len(words) - gram + 1), gram)
    place = np.unique(sliding_argmin(grams, window - gram + 1)[starts])
    return grams[place], place


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    begin, end, first = word_spans(data, offsets, ALNUM_WORDS)
    return word_hashes(data, begin, end), first


def _table(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the first owner of each, and the distinct owners of one key after another."""
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    found, first = np.unique(keys[new], return_index=True)
    return found, np.append(first, int(new.sum())), owner[new]


def block_index(ids: list[str], texts: list[str], window: int, gram: int) -> dict:
    """What tasks need of a block of items: distinct fingerprints, distinct windows and short items, each with the items that hold them."""
    names = sorted(set(ids))
    place_of = {n: i for i, n in enumerate(names)}
    owner = np.array([place_of[x] for x in ids], np.int64)
    words, first = _words(*text_rows(pa.array(texts, pa.large_string())))
    starts, rows = window_starts(first, window)
    tables = {window: _table(window_hashes(words, starts, window), owner[rows])}
    sizes = np.diff(first)
    for m in np.unique(sizes[(sizes > 0) & (sizes < window)]).tolist():
        rows = np.flatnonzero(sizes == m)
        tables[m] = _table(window_hashes(words, first[rows], m), owner[rows])
    return {"names": names, "fingerprints": np.unique(_fingerprints(words, first, window, gram)[0]), "tables": tables}


def _places(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted table of distinct ones, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _owners(row: np.ndarray, at: np.ndarray, first: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, owner) of hits at some places of a table; a window that a row holds often counts once."""
    size = int(owner.max()) + 1
    pairs = np.unique(row * len(first) + at)
    row, at = pairs // len(first), pairs % len(first)
    counts = first[at + 1] - first[at]
    step = np.cumsum(counts) // AT_ONCE
    found = [np.zeros(0, np.int64)]
    for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(step)) + 1):
        n = counts[some]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at[some]], n)
        found.append(np.unique(np.repeat(row[some], n) * size + owner[place]))
    both = np.unique(np.concatenate(found))
    return both // size, both % size


def hit_spans(words: np.ndarray, first: np.ndarray, index: dict, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, begin and end of the windows of a piece that items of a block hold, and the distinct (row, item)."""
    spans, held = [(np.zeros(0, np.int64),) * 3], [(np.zeros(0, np.int64),) * 2]
    for m, (keys, cut, owner) in index["tables"].items():
        starts, rows = window_starts(first, m)
        if not len(starts) or not len(keys):
            continue
        if m == window:
            grams = window_hashes(words, np.arange(len(words) - gram + 1), gram)
            place = sliding_argmin(grams, window - gram + 1)[starts]
            shared = np.zeros(len(grams), bool)
            least = np.unique(place)
            shared[least] = _places(grams[least], index["fingerprints"]) >= 0
            starts, rows = starts[shared[place]], rows[shared[place]]
        at = _places(window_hashes(words, starts, m), keys)
        starts, rows, at = starts[at >= 0], rows[at >= 0], at[at >= 0]
        spans.append((rows, starts, starts + m))
        held.append(_owners(rows, at, cut, owner))
    return (*(np.concatenate(x) for x in zip(*spans, strict=True)), *(np.concatenate(x) for x in zip(*held, strict=True)))


def _search(column: pa.Array, index: dict, window: int, gram: int, old_spans: list | None, old_items: list | None) -> list[tuple[int, np.ndarray, list[str]]]:
    """Of each row: number of words, merged hit spans as flat (begin, end) pairs, names of the items."""
    out: list[tuple[int, np.ndarray, list[str]]] = []
    for low, _, data, offsets in pieces(column):
        words, first = _words(data, offsets)
        row, begin, end, item_row, item = hit_spans(words, first, index, window, gram)
        order, items = np.lexsort((begin, row)), np.argsort(item_row, kind="stable")
        row, begin, end, item_row, item = row[order], begin[order], end[order], item_row[items], item[items]
        cut, item_cut = (np.searchsorted(x, np.arange(len(first))) for x in (row, item_row))
        for r, n in enumerate(np.diff(first).tolist()):
            a, b = cut[r], cut[r + 1]
            spans = _merged(np.stack([begin[a:b], end[a:b]], 1) - first[r])
            names = {index["names"][x] for x in item[item_cut[r] : item_cut[r + 1]].tolist()}
            if old_spans is not None:
                spans = np.concatenate([spans, np.frombuffer(old_spans[low + r] or b"", np.int32).reshape(-1, 2)])
                names |= set(old_items[low + r] or ())
            out.append((n, _merged(spans), sorted(names)))
    return out


def _merged(spans: np.ndarray) -> np.ndarray:
    if len(spans) < 2:
        return spans.astype(np.int32)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
    return np.stack([spans[new, 0], reach[last]], 1).astype(np.int32)


def _verdict(n: int, spans: np.ndarray, items: list[str]) -> tuple[int, int, int, str, bool]:
    hit = int((spans[:, 1] - spans[:, 0]).sum())
    return n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0 and 20 * hit >= n


def _blocks(benchmark: DataFrame, window: int, gram: int, block_bytes: int) -> Iterator[Broadcast]:
    """Broadcast indexes of the blocks; one without items if there are none."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        rows = part.collect()  # at most about block_bytes: the number of blocks follows the table
        yield spark.sparkContext.broadcast(block_index([r[0] for r in rows], [r[1] for r in rows], window, gram))


def _pass_by(frame: DataFrame, benchmark: DataFrame, schema: str, finish: Callable, window: int, gram: int, block_bytes: int) -> DataFrame:
    """Stream the frame past each block; finish(batch, results) makes the batch that the last pass yields."""
    if not 0 < gram < window:
        raise ValueError("a gram must be shorter than a window")
    blocks = list(_blocks(benchmark, window, gram, block_bytes))
    names, place = frame.columns, frame.columns.index("text")
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in frame.schema)
    for k, block in enumerate(blocks):
        first, last = k == 0, k == len(blocks) - 1

        def run(batches: Iterator[pa.RecordBatch], block=block, first=first, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                state = (None, None) if first else (batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist())
                found = _search(batch.column(place), block.value, window, gram, *state)
                rows = pa.RecordBatch.from_arrays(batch.columns[: len(names)], names)
                if last:
                    yield finish(rows, found)
                else:
                    held = [pa.array([x[1].tobytes() for x in found], pa.binary()), pa.array([x[2] for x in found], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*rows.columns, *held], [*names, "hit spans", "hit items"])

        frame = frame.mapInArrow(run, schema if last else f"{kinds}, `hit spans` binary, `hit items` array<string>")
    return frame


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: its words, the words hit, the items hit and the verdict (a twentieth of the words or more)."""

    def finish(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        rows = [_verdict(*x) for x in found]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        )

    frame = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _pass_by(frame, benchmark, f"doc_id bigint, {RESULT}", finish, window, gram, block_bytes)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, all columns as they were."""

    def finish(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        return batch.filter(pa.array([not _verdict(*x)[4] for x in found], pa.bool_()))

    return _pass_by(documents, benchmark, documents.schema, finish, window, gram, block_bytes)


def op5_decontamination(spark, folder: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
