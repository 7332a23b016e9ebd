"""Language of a text by cross-parsing entropy.

For every language a suffix automaton is built of ``sample_bytes`` of labelled text, and a text is parsed greedily into the longest
pieces that occur in that sample. The fewer pieces it takes, the closer the text is to the sample: the language with the fewest
pieces per byte wins. Samples have one size, so counts compare without further norming; a language with less
labelled text gets a smaller sample and its counts are scaled by log(bytes) as the length of a match grows with it.

The fit reads a bounded number of distinct labelled texts per language (``sample_texts``, those whose hash is least), and of each of them
``SPANS`` spans spread over the whole text; the samples (``sample_bytes`` a language) are gathered on the driver. Every language is fitted.
Automata are dense tables over the byte classes of the samples, broadcast in blocks of ``BLOCK`` languages; a text meets one block after
another, and its two least costs are kept. Texts are parsed whole, in strips of ``STRIP`` bytes that advance together.

Results for odd input: a null text or one without a letter is ``und`` with score 0, and so is every text if nothing is labelled; a
null label is not learned; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trustlens.llm.flat import LOWER, pieces

SAMPLE_BYTES = 24_000
SAMPLE_TEXTS = 64
SPANS = 8
BLOCK = 8
STRIP = 256
AT_ONCE = 4 << 20
FAIL = np.int32(-(1 << 31))  # mark of a step that begins a new piece


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the least automaton that accepts the substrings of the text; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in text:
        now = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return step


def parse_table(text: bytes, kinds: np.ndarray, width: int) -> np.ndarray:
    """Flat table: at state * width + class the next state, times the width; where the piece ends, the state after the next piece's first byte, marked."""
    step = suffix_automaton(text)
    table = np.full((len(step), width), -1, np.int64)
    for state, moves in enumerate(step):
        for c, to in moves.items():
            table[state, kinds[c]] = to
    root = np.where(table[0] < 0, 0, table[0])  # a byte that the sample lacks is a piece of its own
    table = np.where(table < 0, (root * width) | int(FAIL), table * width)
    table[0] = (root * width) | int(FAIL)  # from the start every byte begins a piece
    return table.astype(np.int64).astype(np.int32).ravel()


def samples(documents: DataFrame, learn, sample_bytes: int, sample_texts: int) -> dict[str, bytes]:
    """Joined spans of the texts of each language, lower-cased, at most sample_bytes a language."""
    labelled = documents.where(learn & F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("key")
    )
    by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "key"), "doc_id", "key")
    distinct = labelled.select("lang", "doc_id", "key").distinct()
    chosen = distinct.withColumn("r", F.row_number().over(by)).where(F.col("r") <= sample_texts).select(*(F.col(c).alias(f"chosen {c}") for c in ("lang", "doc_id", "key")))
    same = [F.col(c).eqNullSafe(F.col(f"chosen {c}")) for c in ("lang", "doc_id", "key")]
    span = max(1, -(-sample_bytes // (8 * SPANS)))  # no text is more than an eighth of a sample, so that one odd text does not make it
    size = F.length("text")
    starts = [F.when(size <= SPANS * span, F.lit(i * span)).otherwise(F.floor((size - span) * i / (SPANS - 1))).cast("int") for i in range(SPANS)]
    spans = F.filter(F.array(*(F.col("text").substr(x + 1, F.lit(span)) for x in starts)), lambda x: F.length(x) > 0)
    rows = (
        labelled.join(F.broadcast(chosen), same[0] & same[1] & same[2], "left_semi").select("lang", "doc_id", "key", spans.alias("spans"))
        .groupBy("lang", "doc_id", "key").agg(F.min("spans").alias("spans")).collect()  # at most sample_texts a language
    )
    texts: dict[str, list[list[str]]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["key"], r["doc_id"] is None, r["doc_id"] or 0)):
        texts.setdefault(r["lang"], []).append(r["spans"])
    joined: dict[str, bytes] = {}
    for lang, every in texts.items():
        # one span of each text before a second one of any, each text's first taken from another place
        taken = [own[(turn + k) % len(own)] for turn in range(SPANS) for k, own in enumerate(every) if turn < len(own)]
        joined[lang] = LOWER[np.frombuffer("".join(f"{x}\n" for x in taken).encode(), np.uint8)].tobytes()[:sample_bytes]
    return joined


def models(sampled: dict[str, bytes]) -> dict:
    kinds = np.zeros(256, np.int64)
    used = sorted(set(b"".join(sampled.values())))
    kinds[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1
    names = sorted(sampled)
    return {"names": names, "kinds": kinds[LOWER].astype(np.int32), "tables": [parse_table(sampled[n], kinds, width) for n in names], "norm": [math.log2(len(sampled[n]) + 2) for n in names]}


def pieces_per_row(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Number of pieces of each row under each table."""
    sizes = np.diff(offsets)
    strips = -(-sizes // STRIP)
    rows = np.repeat(np.arange(len(sizes)), strips)
    ends = np.cumsum(strips)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - (ends - strips)[rows]
    begin = offsets[:-1][rows] + at * STRIP
    left = np.minimum(offsets[1:][rows] - begin, STRIP)
    order = np.argsort(-left, kind="stable")
    begin, left, rows = begin[order], left[order], rows[order]
    alive = np.searchsorted(-left, -np.arange(STRIP), "left")  # strips longer than t
    symbols = kinds[data]
    out = np.zeros((len(tables), len(sizes)))
    for k, table in enumerate(tables):
        state, count = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int32)
        for t in range(STRIP):
            n = alive[t]
            if not n:
                break
            moved = table[state[:n] + symbols[begin[:n] + t]]
            count[:n] -= moved >> 31
            state[:n] = moved & 0x7FFFFFFF
        out[k] = np.bincount(rows, weights=count, minlength=len(sizes))
    return out


def identify(documents: DataFrame, learn=None, held_out=None, sample_bytes: int = SAMPLE_BYTES, sample_texts: int = SAMPLE_TEXTS, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, lang_pred, score (how far the second language lies behind: 0 for a tie). ``learn`` says which rows may be learned from."""
    learn = F.lit(True) if learn is None else learn
    held_out = F.lit(False) if held_out is None else held_out
    sampled = samples(documents, learn, sample_bytes, sample_texts)
    every = sorted(sampled)
    fits = [documents.sparkSession.sparkContext.broadcast(models({n: sampled[n] for n in every[i : i + block]})) for i in range(0, len(every), block)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*every, "und"])
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column(3), AT_ONCE):
                rows = batch.slice(low, high - low)
                lettered = rows.column(2).to_numpy(zero_copy_only=False)
                best, least, second = np.full(high - low, len(every)), np.full(high - low, np.inf), np.full(high - low, np.inf)
                for k, fit in enumerate(fits):
                    fitted = fit.value
                    cost = pieces_per_row(data, offsets, fitted["kinds"], fitted["tables"]) * np.array(fitted["norm"])[:, None]
                    first = np.argmin(cost, 0)
                    own = cost[first, np.arange(high - low)]
                    if len(cost) > 1:
                        second = np.minimum(second, np.partition(cost, 1, 0)[1])
                    second = np.minimum(second, np.maximum(least, own))
                    best, least = np.where(own < least, k * block + first, best), np.minimum(least, own)
                    if len(fits) > 1:  # a worker holds one block at a time
                        del fitted
                        fit.__dict__.pop("_value", None)
                best = np.where(lettered, best, len(every))
                known = lettered & (second > 0) & (len(every) > 0)
                score = np.where(known, 1 - np.where(known, least, 0.0) / np.maximum(second, 1e-9), 0.0)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(names[best]), pa.array(np.clip(score, 0, 1))], ["doc_id", "held_out", "lang_pred", "score"])

    texts = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), F.col("text").cast("string").alias("text"),
    )
    return texts.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op4_language_id(spark, folder: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return identify(spark.read.parquet(f"{folder}/documents.parquet"), fold != 2, fold == 2)
