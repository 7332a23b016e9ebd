"""Words covered by a long word run that an earlier document holds too.

A window is ``length`` consecutive words. A word is removed when a window over it also starts in a document with a smaller
doc_id; windows are judged on the input.

Matching statistics against automata of reference shards need every document beside every shard of the corpus, which grows with
the square of the input. The shards are therefore cut by content: each window belongs to the shard of its anchor, the least
hash of its k-grams, so that equal windows meet in one shard and a document is streamed only through shards it can match. Within
a shard documents arrive in the order of doc_id, the windows seen so far are the shard's reference, and a window found there is
at least ``length`` words of matching statistics.

Results for odd input: a null or empty text has no words; a null doc_id is never earlier nor later than another, so it removes
nothing and keeps all; rows that repeat a doc_id are not earlier than each other; equal rows of a batch send their windows once and
share one set of spans; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlens.llm.flat import BLANK_WORDS, mix, pieces, signed, sliding_argmin, text_rows, window_hashes, window_starts, word_hashes, word_spans
from trustlens.llm.packed import KEYED, flatten, keyed, pack, unpack

LENGTH = 50
GRAM = 8
AT_ONCE = 1 << 20  # windows settled among themselves before any is sent
SHARD = f"anchor bigint, {KEYED}, start int, mask bigint, hashes binary"
FOUND = f"{KEYED}, start int, mask bigint"


def _first_seen(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The least doc of each hash, for every row."""
    order = np.lexsort((docs, hashes))
    ordered = hashes[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    least = np.empty(len(docs), np.int64)
    least[order] = docs[order][np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    return least


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """The place of the first of each group of equal rows, ascending."""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    return np.sort(order[new])


def _runs(column: pa.Array, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of every window: row, start, hash and the hash and place of its anchor; in groups of whole texts with about AT_ONCE windows."""
    out, held = [], 0
    for low, _, data, offsets in pieces(column):
        begin, end, first = word_spans(data, offsets, BLANK_WORDS)
        starts, rows = window_starts(first, length)
        if not len(starts):
            continue
        words = word_hashes(data, begin, end)
        grams = window_hashes(words, np.arange(len(words) - gram + 1), gram)
        place = sliding_argmin(grams, length - gram + 1)[starts]
        narrow = [(x - first[rows]).astype(np.int32) for x in (starts, place)]
        out.append(((rows + low).astype(np.int32), narrow[0], window_hashes(words, starts, length), grams[place], narrow[1]))
        held += len(starts)
        if held >= AT_ONCE:
            yield tuple(np.concatenate(x) for x in zip(*out, strict=True))
            out, held = [], 0
    if out:
        yield tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _masks(run: np.ndarray, bit: np.ndarray, chosen: np.ndarray, runs: int) -> np.ndarray:
    mask = np.zeros(runs, np.uint64)
    np.bitwise_or.at(mask, run[chosen], np.uint64(1) << bit[chosen].astype(np.uint64))
    return mask


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary cell per count of values."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def shard_rows(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per run of windows with one anchor.

    A window whose hash has a smaller doc_id in the same group of texts is settled already: it is marked in a row without hashes and not
    sent to its shard, so a very frequent passage sends one row per group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            doc, known = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
            key = batch.column(1).to_numpy(zero_copy_only=False)
            once = np.flatnonzero(known)[_distinct(key[known], doc[known])]
            doc, key = doc[once], key[once]
            for row, start, whole, anchor, place in _runs(batch.column(2).take(pa.array(once)), length, gram):
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
                head = np.flatnonzero(new)
                of = np.cumsum(new) - 1
                bit = start - start[head][of]
                settled = _first_seen(whole, doc[row]) < doc[row]
                counts = np.bincount(of[~settled], minlength=len(head))
                open_runs, done_runs = counts > 0, np.bincount(of[settled], minlength=len(head)) > 0
                open_mask, done_mask = _masks(of, bit, ~settled, len(head)), _masks(of, bit, settled, len(head))
                hashes = whole[~settled]
                for chosen, anchors, mask, cells in (
                    (open_runs, anchor[head][open_runs], open_mask, _binary(hashes, counts[open_runs])),
                    (done_runs, mix(anchor[head][done_runs] + doc[row[head]][done_runs].astype(np.uint64)), done_mask, None),
                ):
                    at = head[chosen]
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(signed(anchors)), pa.array(doc[row[at]]), pa.array(key[row[at]]), pa.array(start[at].astype(np.int32)),
                                pa.array(signed(mask[chosen])), cells if cells is not None else pa.nulls(len(at), pa.binary()),
                            ],
                            ["anchor", "doc_id", "text_key", "start", "mask", "hashes"],
                        )

    return texts.mapInArrow(run, SHARD)


def stream_shards(rows: DataFrame) -> DataFrame:
    """Runs with the windows that an earlier document of their shard holds.

    Rows are sorted by shard and doc_id; beyond a batch only the distinct windows of the shard at its end are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held_hash, held_doc = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column(0).to_numpy()
            cells = batch.column(5)
            settled = ~cells.is_valid().to_numpy(zero_copy_only=False)
            data, offsets = text_rows(cells)
            hashes = data.view(np.uint64)
            counts = np.diff(offsets) // 8
            of = np.repeat(np.arange(len(anchor)), counts)
            doc = batch.column(1).to_numpy()
            if last != anchor[0]:
                held_hash, held_doc = held_hash[:0], held_doc[:0]
            least = _first_seen(np.concatenate([held_hash, hashes]), np.concatenate([held_doc, doc[of]]))
            mask = batch.column(4).to_numpy().view(np.uint64).copy()
            found = least[len(held_hash) :] < doc[of]
            rank = np.arange(len(of)) - np.concatenate([[0], np.cumsum(counts)])[of]
            bits = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            bits[settled] = False
            row_of_bit, bit = np.nonzero(bits)  # in the order of the hashes
            assert len(bit) == len(of) and (not len(rank) or rank.max() < 64)
            removed = np.where(settled, mask, np.uint64(0))
            np.bitwise_or.at(removed, row_of_bit[found], np.uint64(1) << bit[found].astype(np.uint64))
            hit = np.flatnonzero(removed)
            if len(hit):
                hit = hit[_distinct(removed[hit], batch.column(2).to_numpy()[hit], batch.column(3).to_numpy()[hit], doc[hit], anchor[hit])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(hit), batch.column(2).take(hit), batch.column(3).take(hit), pa.array(signed(removed[hit]))],
                    ["doc_id", "text_key", "start", "mask"],
                )
            tail = anchor[of] == anchor[-1]
            carried = last == anchor[-1]
            merged = np.concatenate([held_hash[: len(held_hash) if carried else 0], hashes[tail]])
            docs = np.concatenate([held_doc[: len(held_doc) if carried else 0], doc[of][tail]])
            held_hash, at = np.unique(merged, return_index=True)  # the first place is the least doc_id: rows come in that order
            held_doc = docs[at]
            last = anchor[-1]

    return rows.repartition("anchor").sortWithinPartitions("anchor", "doc_id").mapInArrow(run, FOUND)


def covered(rows: np.ndarray, starts: np.ndarray, masks: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Which words of a piece lie in a window that is marked."""
    edge = np.zeros(int(first[-1]) + 1, np.int64)
    bits = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(bits)
    begin = first[rows[at]] + starts[at] + bit
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + length, -1)
    return np.cumsum(edge)[:-1] > 0


def joined_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, each with a blank behind it, and the place of each word."""
    sizes = end - begin + 1
    place = np.concatenate([[0], np.cumsum(sizes)])
    index = np.repeat(begin - place[:-1], sizes) + np.arange(place[-1])
    out = data[np.minimum(index, max(len(data) - 1, 0))] if len(data) else np.zeros(0, np.uint8)
    out[place[1:] - 1] = 0x20
    return out, place


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if wanted, the kept words joined by one blank."""
    if not gram < length <= 64 + gram - 1:
        raise ValueError("a window must be longer than a gram and have at most 64 grams")
    texts = keyed(documents)
    found = stream_shards(shard_rows(texts, length, gram))
    per_row = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "mask")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            counts = np.diff(spans.offsets.to_numpy()) if len(batch) else np.zeros(0, np.int64)
            counts = np.where(spans.is_valid().to_numpy(zero_copy_only=False), counts, 0)
            inner = spans.flatten()
            start, mask = (inner.field(i).to_numpy() for i in (0, 1))
            rows = np.repeat(np.arange(len(counts)), counts)
            column = flatten(unpack(batch.column(1)))
            for low, high, data, offsets in pieces(column):
                begin, end, first = word_spans(data, offsets, BLANK_WORDS)
                mine = (rows >= low) & (rows < high)
                gone = covered(rows[mine] - low, start[mine], mask[mine].view(np.uint64), first, length)
                total = np.concatenate([[0], np.cumsum(~gone)])
                out, place = joined_words(data, begin[~gone], end[~gone])
                left = total[first]
                raw = out.tobytes()
                kept = [raw[a : max(a, b - 1)] for a, b in zip(place[left[:-1]].tolist(), place[left[1:]].tolist(), strict=True)]
                n = np.diff(first)
                arrays = [batch.column(0).slice(low, high - low), pa.array(n), pa.array(n - np.diff(left)), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.binary()).cast(pa.string())] * with_text, [*("doc_id", "n_words", "n_removed", "kept_sha256"), *["kept"] * with_text])

    joined = pack(texts).join(per_row, ["doc_id", "text_key"], "left").select("doc_id", "packed", "found")
    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text)


def op6_substring_dedup(spark, folder: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{folder}/documents.parquet"), with_text=False)
