"""Quality of a text from its bytes by a convolutional network in numpy.

Bytes are embedded, learned filters of ``2 * BLOCK`` bytes run over the text every ``BLOCK`` bytes, their answers are max-pooled over
chunks of ``CHUNK`` blocks that overlap by ``CHUNK - STEP`` blocks and together cover the whole text, and the mean and
the maximum over the chunks give one probability through a logistic layer.

The fit reads at most ``per_class`` labelled ids of each class (those whose hash is least) and at most ``views`` evenly
spread chunks of each; classes are weighted back to their share of all labelled ids. Embedding, filters and logistic layer are learned together
by Adam on the driver; the sample is bounded by 2 * per_class * views chunks whatever the tables hold.

Results for odd input: a null or empty text is scored as one chunk without bytes; without labels of both classes every score is the
share of label 1, or 0.5 if there are none; repeated rows are scored alike; a doc_id with several labels is learned with each, one with
several texts by the text whose hash is least, so that no id weighs more for being repeated; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlens.llm.flat import pieces

BLOCK = 4
CHUNK, STEP = 128, 112  # blocks
WIDTH = 8
FILTERS = 24
PER_CLASS = 1500
VIEWS = 8
EPOCHS = 8
BATCH = 50
SEED = 7
THRESHOLD = 0.3


def blocks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes + 1 in rows of BLOCK, each text filled up with zeros to whole blocks and one block more; the first block of each text."""
    sizes = np.diff(offsets)
    blocks = -(-sizes // BLOCK) + 1
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(int(first[-1]) * BLOCK, np.int16)
    out[np.arange(len(data)) + np.repeat(first[:-1] * BLOCK - offsets[:-1], sizes)] = data.astype(np.int16) + 1
    return out.reshape(-1, BLOCK), first


def chunk_bounds(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end block of each chunk, and the first chunk of each text. Windows begin at every block but a text's last."""
    sizes = np.diff(first) - 1
    chunks = np.maximum(1, -(-(sizes - (CHUNK - STEP)) // STEP))
    head = np.concatenate([[0], np.cumsum(chunks)])
    rows = np.repeat(np.arange(len(sizes)), chunks)
    begin = first[:-1][rows] + (np.arange(int(head[-1])) - head[:-1][rows]) * STEP
    return begin, np.maximum(np.minimum(begin + CHUNK, first[1:][rows] - 1), begin + 1), head


def answers(blocks: np.ndarray, net: dict) -> np.ndarray:
    """Filter answers of the window that begins at each block (the last has none of its own)."""
    embedded = net["embed"][blocks].reshape(len(blocks), -1)
    both = embedded @ net["kernel"]
    filters = both.shape[1] // 2
    both[:-1, :filters] += both[1:, filters:]
    return both[:, :filters]


def pooled(blocks: np.ndarray, first: np.ndarray, net: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maxima of each chunk, its bounds and the first chunk of each text."""
    begin, end, head = chunk_bounds(first)
    edges = np.empty(2 * len(begin), np.int64)
    edges[::2], edges[1::2] = begin, end
    padded = np.concatenate([answers(blocks, net), np.zeros((1, net["kernel"].shape[1] // 2), np.float32)])
    return np.maximum.reduceat(padded, edges, axis=0)[::2], begin, end, head


def combined(peaks: np.ndarray, head: np.ndarray, net: dict) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text (mean and maximum of the chunks' squashed maxima) and its logit."""
    lit = np.tanh(peaks + net["shift"])
    n = np.diff(head)[:, None]
    features = np.concatenate([np.add.reduceat(lit, head[:-1], axis=0) / n, np.maximum.reduceat(lit, head[:-1], axis=0)], 1)
    return features, features @ net["weight"] + net["bias"][0]


def fit(texts: list[list[bytes]], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Learn the network from lists of chunks."""
    rng = np.random.default_rng(seed)
    net = {
        "embed": rng.normal(0, 0.5, (257, WIDTH)), "kernel": rng.normal(0, 0.15, (BLOCK * WIDTH, 2 * FILTERS)),
        "shift": np.full(FILTERS, -1.0), "weight": rng.normal(0, 0.1, 2 * FILTERS), "bias": np.zeros(1),
    }
    net = {k: v.astype(np.float32) for k, v in net.items()}
    net["embed"][0] = 0
    slow = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    made = [[blocks_of(np.frombuffer(c, np.uint8), np.array([0, len(c)]))[0][: CHUNK + 1] for c in t] for t in texts]
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            chunks = [c for i in chosen for c in made[i]]
            head = np.concatenate([[0], np.cumsum([len(made[i]) for i in chosen])])
            blocks = np.concatenate(chunks)
            first = np.concatenate([[0], np.cumsum([len(c) for c in chunks])])
            said = answers(blocks, net)
            sizes = np.maximum(np.diff(first) - 1, 1)
            where = np.stack([first[i] + said[first[i] : first[i] + sizes[i]].argmax(0) for i in range(len(chunks))])
            peaks = said[where, np.arange(FILTERS)]
            features, logit = combined(peaks, head, net)
            error = (1 / (1 + np.exp(-logit)) - labels[chosen]) * weights[chosen]
            error = (error / weights[chosen].sum()).astype(np.float32)
            grad = {"weight": features.T @ error, "bias": error.sum(keepdims=True)}
            lit = np.tanh(peaks + net["shift"])
            text_of = np.repeat(np.arange(len(chosen)), np.diff(head))
            back = error[text_of, None] * net["weight"][None, :FILTERS] / np.diff(head)[text_of, None]
            top = lit == features[text_of, FILTERS:]
            back = back + error[text_of, None] * net["weight"][None, FILTERS:] * top / np.maximum(np.add.reduceat(top, head[:-1], axis=0, dtype=np.float32), 1)[text_of]
            back = back * (1 - lit * lit)
            grad["shift"] = back.sum(0)
            grad["kernel"], grad["embed"] = np.zeros_like(net["kernel"]), np.zeros_like(net["embed"])
            following = np.minimum(where + 1, len(blocks) - 1)
            for f in range(FILTERS):
                for half, rows in ((0, where[:, f]), (1, following[:, f])):
                    symbols = blocks[rows]
                    signal = back[:, f].astype(np.float32)
                    column = half * FILTERS + f
                    grad["kernel"][:, column] += signal @ net["embed"][symbols].reshape(len(rows), -1)
                    np.add.at(grad["embed"], symbols.ravel(), (signal[:, None] * net["kernel"][:, column]).reshape(-1, WIDTH))
            grad["embed"][0] = 0
            t += 1
            for k, g in grad.items():
                m, v = slow[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                rate = 0.02 if epoch < epochs - 2 else 0.005
                net[k] -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return net


def probabilities(data: np.ndarray, offsets: np.ndarray, net: dict) -> np.ndarray:
    blocks, first = blocks_of(data, offsets)
    peaks, _, _, head = pooled(blocks, first, net)
    return 1 / (1 + np.exp(-combined(peaks, head, net)[1].astype(np.float64)))


def training_sample(documents: DataFrame, labels: DataFrame, learn: Column, per_class: int, views: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, float]:
    """Chunks, labels and weights of the sampled rows, and the share of label 1 among all that may be learned."""
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(learn & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).distinct()
    counts = {r[0]: r[1] for r in marked.groupBy("quality").agg(F.count("*")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    chosen = None
    for q in (0, 1):
        some = marked.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    length, room = F.length("text"), CHUNK * BLOCK
    n = F.least(F.lit(views), F.greatest(F.lit(1), F.ceil(length / F.lit(room)).cast("int")))
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("text"), F.lit(1) + F.floor(i * F.greatest(length - room, F.lit(0)) / F.greatest(n - 1, F.lit(1))).cast("int"), F.lit(room)))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("text_key"), parts.alias("parts"))
    rows = found.groupBy("doc_id", "quality").agg(F.min(F.struct("text_key", "parts"))["parts"].alias("parts")).collect()  # at most per_class of each class
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["parts"]))
    got = {q: sum(r["quality"] == q for r in rows) for q in (0, 1)}
    weight = {q: counts.get(q, 0) / max(got[q], 1) for q in (0, 1)}
    return [[p.encode()[: CHUNK * BLOCK] for p in r["parts"]] for r in rows], np.array([r["quality"] for r in rows]), np.array([weight[r["quality"]] for r in rows]), prior


def score_quality(documents: DataFrame, labels: DataFrame, learn: Column | None = None, held_out: Column | None = None, per_class: int = PER_CLASS, views: int = VIEWS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, held_out, score, predicted. ``learn`` says which labelled rows may be learned from."""
    texts, marks, weights, prior = training_sample(documents, labels, F.lit(True) if learn is None else learn, per_class, views)
    net = fit(texts, marks, weights, epochs) if 0 < marks.sum() < len(marks) else None
    sent = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column(2), 1 << 17):
                score = probabilities(data, offsets, net) if net else np.full(high - low, prior)
                arrays = [batch.column(i).slice(low, high - low) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.lit(False) if held_out is None else held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def op7_quality_classifier(spark, folder: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return score_quality(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), fold != 0, fold == 0)
