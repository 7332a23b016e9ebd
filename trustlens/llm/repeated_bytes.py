"""Bytes covered by a string of ``length`` bytes that also starts anywhere else in the corpus.

Equal prefixes of ``length`` bytes lie beside each other in the suffix order of the corpus; a byte is removed when such a prefix covers it.
The suffix order is not spelled out for every byte: a difference cover of fixed residues makes two thirds of all positions samples, which
at 16 bytes a sample is more than ten times the input on disk. Samples are chosen by content instead. The sample
of a window of ``length`` bytes is its least ``gram``-byte hash, so two equal windows sample the same place, and about one position in
ninety is a sample.

1. A run is the windows with one sample; it is named by the sample's gram and by all bytes of its windows. Samples are sorted by
   gram and name. Adjacent equal names make all windows of a run repeated; a gram that occurs once makes none repeated.
2. Only runs whose gram occurs elsewhere with other bytes around are left, mostly at the edges of repeated passages. Of each name one
   copy, and every run that has not been settled, is compared byte window by byte window within its gram: window
   prefixes are sorted, and adjacent equal ones are repeats.
3. The windows found are joined into spans of their documents.

A group of texts first settles what repeats inside it and sends each name once, so a very frequent passage sends one row per group of
texts. A gram with more than ``HOT`` names is dealt on by the hash of each window instead of being compared in one task.

Results for odd input: a null text is empty; texts shorter than a window have nothing removed; rows that repeat a doc_id, or have none, are
places of their own; very long texts are handled whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlens.llm.components import stored
from trustlens.llm.flat import byte_window_hashes, mix, pieces, signed, sliding_argmin, window_starts, word_hashes
from trustlens.llm.packed import KEYED, flatten, keyed, pack, unpack

LENGTH = 200
GRAM = 16
AT_ONCE = 8 << 20  # bytes of text whose runs are settled among themselves before any is sent
HOT = 1 << 16

RUNS = f"gram bigint, name bigint, {KEYED}, start int, windows int, twice boolean"
FOUND = f"gram bigint, {KEYED}, start int, windows int, state int"
SETTLED, OPEN, COPY, HOT_OPEN, HOT_COPY = range(5)  # repeated; to be compared; only to be compared with; the same for a hot gram


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, start, number of windows, gram and name of each run."""
    starts, rows = window_starts(offsets, length)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    grams = byte_window_hashes(data, np.arange(len(data) - gram + 1), gram)
    place = sliding_argmin(grams, length - gram + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (place[1:] != place[:-1])
    head = np.flatnonzero(new)
    windows = np.diff(np.append(head, len(starts)))
    begin, at = starts[head], place[head]
    names = mix(word_hashes(data, begin, begin + windows + length - 1) ^ mix((at - begin).astype(np.uint64) + np.uint64(1 << 40)))
    return rows[head], begin - offsets[rows[head]], windows, grams[at], names


def sample_runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of all texts; of those with one name in a group of texts the first is sent, and the others are settled (no gram)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(group: list[tuple], doc: np.ndarray, valid: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
            row, start, windows, grams, names = (np.concatenate(x) for x in zip(*group, strict=True))
            _, first, of, counts = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
            twice = counts[of] > 1
            lead = np.zeros(len(row), bool)
            lead[first] = True
            gram_column = pa.array(signed(np.where(lead, grams, mix(names + row.astype(np.uint64)))))
            name_column = pa.array(signed(names), mask=~lead)
            return pa.RecordBatch.from_arrays(
                [gram_column, name_column, pa.array(doc[row], mask=~valid[row]), pa.array(key[row]), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(twice)],
                ["gram", "name", "doc_id", "text_key", "start", "windows", "twice"],
            )

        for batch in batches:
            doc, valid = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            key = batch.column(1).to_numpy()
            group, held = [], 0
            for low, _, data, offsets in pieces(batch.column(2)):
                row, *rest = runs_of(data, offsets, length, gram)
                if len(row):
                    group.append((row + low, *rest))
                held += len(data)
                if held >= AT_ONCE and group:
                    yield made(group, doc, valid, key)
                    group, held = [], 0
            if group:
                yield made(group, doc, valid, key)

    return texts.mapInArrow(run, RUNS)


def settle(runs: DataFrame, hot: int) -> DataFrame:
    """States of the runs that may be repeated, by comparing adjacent names of each gram.

    A gram's runs are held until it ends, up to ``hot`` of them; a gram with more is known to be hot then and its rows pass on as they come.
    Whether a name occurs twice is known from its neighbours in the order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, hot_gram = 0, None

        def classify(table: pa.Table, whole: bool) -> pa.RecordBatch | None:
            """States of the rows; unless ``whole``, all of one gram that is hot."""
            gram, lead = table.column(0).to_numpy(), table.column(1).combine_chunks().is_valid().to_numpy(zero_copy_only=False)
            name = table.column(1).combine_chunks().fill_null(0).to_numpy()
            twice = table.column(6).to_numpy()
            new_gram = np.ones(len(gram), bool)
            new_gram[1:] = gram[1:] != gram[:-1]
            new_name = np.ones(len(gram), bool)
            new_name[1:] = new_gram[1:] | (name[1:] != name[:-1]) | ~lead[1:] | ~lead[:-1]
            of_name, of_gram = np.cumsum(new_name) - 1, np.cumsum(new_gram) - 1
            repeated = (np.bincount(of_name)[of_name] > 1) | (np.bincount(of_name, weights=twice)[of_name] > 0)
            names_of_gram = np.bincount(of_gram, weights=new_name & lead)
            state = np.full(len(gram), -1)
            state[repeated | ~lead] = SETTLED
            several = (names_of_gram[of_gram] > 1) if whole else np.ones(len(gram), bool)
            some_open = np.bincount(of_gram, weights=lead & ~repeated)[of_gram] > 0 if whole else np.ones(len(gram), bool)
            compared = lead & several & some_open
            state[compared & ~repeated] = OPEN if whole else HOT_OPEN
            copy = compared & repeated & new_name  # one of each name, besides its span
            rows = np.concatenate([np.flatnonzero(state >= 0), np.flatnonzero(copy)])
            states = np.concatenate([state[state >= 0], np.full(int(copy.sum()), COPY if whole else HOT_COPY)])
            if not len(rows):
                return None
            columns = [table.column(k).combine_chunks().take(rows) for k in (0, 2, 3, 4, 5)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(states.astype(np.int32))], ["gram", "doc_id", "text_key", "start", "windows", "state"])

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held and (made := classify(pa.Table.from_batches(held), whole)) is not None:
                yield made
            held, size = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column(0).to_numpy()
            if hot_gram is not None:
                same = int(np.searchsorted(gram, hot_gram, "right"))
                if same:
                    held.append(batch.slice(0, same))
                    yield from flush(False)
                batch, gram = batch.slice(same), gram[same:]
                if not len(gram):
                    continue
                hot_gram = None
            begin = int(np.searchsorted(gram, gram[-1]))
            if begin or held and held[-1].column(0)[-1].as_py() != gram[-1]:
                if begin:
                    held.append(batch.slice(0, begin))
                yield from flush(True)
                batch = batch.slice(begin)
            held.append(batch)
            size += batch.num_rows
            if size > hot:
                hot_gram = int(gram[-1])
                yield from flush(False)
        yield from flush(True)

    return runs.repartition("gram").sortWithinPartitions("gram", "name").mapInArrow(run, FOUND)


def windows_to_compare(candidates: DataFrame, packed: DataFrame, length: int) -> DataFrame:
    """Rows (key, doc_id, text_key, start, open, bytes): the bytes of a run's windows, or for a hot gram each window's hash."""
    per_row = candidates.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("gram", "start", "windows", "state")).alias("found")).withColumnRenamed("doc_id", "d").withColumnRenamed("text_key", "k")
    joined = packed.join(per_row, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))).select("doc_id", "text_key", "packed", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = unpack(batch.column(2))
            lists = batch.column(3)
            rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            inner = lists.flatten()
            gram, start, windows, state = (inner.field(i).to_numpy() for i in range(4))
            wide = (state == HOT_OPEN) | (state == HOT_COPY)
            for some in np.array_split(np.flatnonzero(~wide), max(1, int((~wide).sum()) // 4096)):
                cells = [texts[r][a : a + n + length - 1] for r, a, n in zip(rows[some].tolist(), start[some].tolist(), windows[some].tolist(), strict=True)]
                yield of(batch, rows[some], gram[some], start[some], state[some] == OPEN, cells)
            for i in np.flatnonzero(wide).tolist():
                r, n = rows[i], int(windows[i])
                data = np.frombuffer(texts[r], np.uint8)
                hashes = byte_window_hashes(data, np.arange(start[i], start[i] + n), length)
                yield of(batch, np.repeat(r, n), signed(mix(hashes + np.uint64(1))), np.arange(start[i], start[i] + n), np.repeat(state[i] == HOT_OPEN, n), [h.tobytes() for h in hashes])

    def of(batch, rows, keys, starts, is_open, cells) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(keys), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(starts.astype(np.int32)), pa.array(is_open), pa.array(cells, pa.binary())],
            ["key", "doc_id", "text_key", "start", "open", "cell"],
        )

    return joined.mapInArrow(run, f"key bigint, {KEYED}, start int, open boolean, cell binary")


def compare(rows: DataFrame, length: int) -> DataFrame:
    """Spans of the open windows whose bytes occur elsewhere in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            table = pa.Table.from_batches(parts).combine_chunks()
            key, start, is_open = (table.column(k).to_numpy() for k in (0, 3, 4))
            names, of, place = [], [], []
            for low, high, data, offsets in pieces(table.column(5).combine_chunks()):
                at, row = window_starts(offsets, length)
                names.append(byte_window_hashes(data, at, length))
                of.append((row + low).astype(np.int32))
                place.append((start[row + low] + (at - offsets[row])).astype(np.int32))
                hashed = np.flatnonzero(np.diff(offsets) == 8)
                names.append(data[(offsets[hashed][:, None] + np.arange(8)).ravel()].copy().view(np.uint64))
                of.append((hashed + low).astype(np.int32))
                place.append(start[hashed + low])
            names, of, place = (np.concatenate(x) for x in (names, of, place))
            names = mix(names + key[of].view(np.uint64))
            ordered = np.sort(names)
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            del ordered
            repeated = twice[np.minimum(np.searchsorted(twice, names), max(len(twice) - 1, 0))] == names if len(twice) else np.zeros(len(names), bool)
            keep = repeated & is_open[of]
            of, place = of[keep], place[keep]
            if not len(of):
                return None
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (place[1:] != place[:-1] + 1)
            head = np.flatnonzero(new)
            counts = np.diff(np.append(head, len(of)))
            return pa.RecordBatch.from_arrays(
                [table.column(1).combine_chunks().take(of[head]), table.column(2).combine_chunks().take(of[head]), pa.array(place[head].astype(np.int32)), pa.array(counts.astype(np.int32))],
                ["doc_id", "text_key", "start", "windows"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # rows come sorted
            if last or held and held[-1].column(0)[-1].as_py() != key[-1]:
                if last:
                    held.append(batch.slice(0, last))
                if (made := work(held)) is not None:
                    yield made
                held, batch = [], batch.slice(last)
            held.append(batch)
        if held and (made := work(held)) is not None:
            yield made

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, f"{KEYED}, start int, windows int")


def remove_repeated_bytes(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the kept bytes."""
    if not (0 < gram < length and length > 8):
        raise ValueError("a gram must be shorter than a window, and a window longer than 8 bytes")
    texts = keyed(documents)
    found = stored(settle(sample_runs(texts, length, gram), hot), "runs")
    packed = pack(texts)
    edges = compare(windows_to_compare(found.where(F.col("state") > SETTLED), packed, length), length)
    spans = found.where(F.col("state") == SETTLED).select("doc_id", "text_key", "start", "windows").unionByName(edges)
    per_row = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "windows")).alias("found")).withColumnRenamed("doc_id", "d").withColumnRenamed("text_key", "k")
    joined = packed.join(per_row, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").select("doc_id", "packed", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            counts = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0)
            inner = lists.flatten()
            begin, windows = (inner.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            first = np.concatenate([[0], np.cumsum(counts)])
            out = []
            for i, text in enumerate(unpack(batch.column(1))):
                a, b = begin[first[i] : first[i + 1]], windows[first[i] : first[i + 1]]
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, a, 1)
                np.add.at(edge, a + b + length - 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if len(a) else text
                spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0]) if len(gone) else 0
                out.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 5 if with_text else 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 1 + len(kinds)])

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)


def op3_suffix_array_dedup(spark, folder: str) -> DataFrame:
    return remove_repeated_bytes(spark.read.parquet(f"{folder}/documents.parquet"), with_text=False)
