"""Documents linked by the Jaccard similarity of their word shingles, found with an R-tree over group counts.

Texts are lower-cased (A-Z) and cut at blanks; a document's set is its distinct ``width``-word shingles, or its whole word sequence where
it has fewer words. Two documents link when |A n B| >= 0.75 |A u B|.

1. Equal sets are one point; the copies of a point are carried by their ids only.
2. Tokens are hashed into half as many groups as a set has tokens, or more. The vector of group counts is the point; the overlap of two sets is at most the sum of the smaller
   coordinates, and the overlap of a set with anything in a box is at most the sum with the box's upper corner.
3. The top of the tree is cut by content, so that it needs no comparison of everything with everything: tokens are ordered by how
   full their group is in the whole corpus, and two sets that link must share one of the first |A| - ceil(0.75 |A|) + 1 tokens of
   each. A node is the set of points that share such a token; nodes with the same points are one.
4. In every node the points are first compared with the node's centre, one pair per point, by size, by bound and then by the sets themselves.
   In a large node the points are then compared with few members of each other label that stands there. What is still apart is packed into boxes below the node, without the centre and
   without points that meet no other label near their size, and pairs of boxes are descended while their bound allows a link;
   points that are connected already are not compared. A large group of near copies so costs about one verification per point.
5. Surviving pairs are verified on their sets, made again from packed texts that travel once to the block of points that pairs hold together, or to the
   parts of a large one; links are joined into components.

Results for odd input: a document without words (null, empty or blank text) has an empty set, links with nothing and is its own
component; a null doc_id links with nothing and has no component; rows that repeat a doc_id give one row each, and a document is
linked if any of its rows is; other columns are ignored or, in ``one_of_each_group``, kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustlens.llm.components import components, settled, shuffles_removed
from trustlens.llm.flat import BLANK_WORDS, LOWER, mix, pieces, signed, window_hashes, window_starts, word_hashes, word_spans
from trustlens.llm.packed import flatten, keyed, pack, press_texts, text_key, unpack

WIDTH = 5
SHARE = (3, 4)  # similarity of 3/4 or more
ORDER_GROUPS = 1 << 16  # of the corpus-wide counts that order the tokens
LEAF, FAN = 16, 16
HOMES = 16  # of a point's nodes that tell where a pair of points is given
NODE_TOKENS = 4 << 20  # of the points compared in one task
PAIRS_AT_ONCE = 1 << 16
MOST_IDS = 500_000  # broadcast at most
BLOCK_TOKENS = 4 << 20  # of the pairs verified in one task, 32 MB at most
BLOCK_PAIRS = 2048  # of a block verified in one task
CARRY = 1 << 16  # members of a node kept while its rows stream by
LARGE = 64  # points of a node that are compared with members of other labels first
TRIES = 16  # such members for a point and label


def token_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after another, and the first of each row."""
    data = LOWER[data]
    begin, end, first = word_spans(data, offsets, BLANK_WORDS)
    words = word_hashes(data, begin, end)
    starts, rows = window_starts(first, width)
    tokens = window_hashes(words, starts, width)
    sizes = np.diff(first)
    for m in range(1, width):
        at = np.flatnonzero(sizes == m)
        tokens, rows = np.concatenate([tokens, window_hashes(words, first[at], m)]), np.concatenate([rows, at])
    order = np.lexsort((tokens, rows))
    tokens, rows = tokens[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (rows[1:] != rows[:-1])
    tokens, rows = tokens[new], rows[new]
    return tokens, np.searchsorted(rows, np.arange(len(sizes) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[first[1:]] - total[first[:-1]]


def points(first: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    return mix(_sums(mix(tokens ^ np.uint64(0xA0761D6478BD642F)), first) + np.diff(first).astype(np.uint64))


def needed(n: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Tokens that a set shares with any set it links to, at least."""
    return -(-n * share[0] // share[1])


def groups_for(n: int) -> int:
    """Coordinates of a set's vector: a power of two, half its tokens to all of them. Unrelated sets of a size overlap in three of five at most by this bound, and six of seven are needed."""
    return max(64, 1 << int(np.ceil(np.log2(max(n, 1)))) >> 1)


def vector(tokens: np.ndarray) -> np.ndarray:
    """Tokens in each group; more groups in the unlikely case that one holds more than a byte can count."""
    groups = groups_for(len(tokens))
    while (counts := np.bincount((tokens & np.uint64(groups - 1)).astype(np.int64), minlength=groups)).max(initial=0) > 255:
        groups *= 2
    return counts.astype(np.uint8)


def fold(vectors: np.ndarray, groups: int) -> np.ndarray:
    """Vectors (the last axis) with fewer groups: groups that agree in their lower bits are one. Nothing is copied where none are."""
    if vectors.shape[-1] == groups:
        return vectors
    return vectors.reshape(*vectors.shape[:-1], -1, groups).sum(-2, dtype=np.uint32)


def narrow(counts: np.ndarray) -> np.ndarray:
    """The same counts in the narrowest type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))), copy=False)


def digests(texts: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, point, vector (pressed: small counts take about two bits), text_key; the point is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1, write_checksum=False)
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column(1)):
                tokens, first = token_sets(data, offsets, width)
                n = np.diff(first)
                names = pa.array(signed(points(first, tokens)), mask=n == 0)
                vectors = [press.compress(vector(tokens[a:b]).tobytes()) for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(n), names, pa.array(vectors, pa.binary()), batch.column(2).slice(low, high - low)], ["doc_id", "n_shingles", "point", "vector", "text_key"])

    return texts.mapInArrow(run, "doc_id bigint, n_shingles bigint, point bigint, vector binary, text_key bigint")


def group_order(texts: DataFrame, width: int, groups: int) -> np.ndarray:
    """How many tokens of the corpus each group holds, as ranks; the number of groups is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(groups, np.int64)
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(1)):
                tokens, _ = token_sets(data, offsets, width)
                counts += np.bincount((tokens % np.uint64(groups)).astype(np.int64), minlength=groups)
        for at in range(0, groups, 4096):
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([counts[at : at + 4096].tolist()], pa.list_(pa.int64()))], ["at", "counts"])

    parts = texts.mapInArrow(run, "at bigint, counts array<bigint>")
    pairs = parts.select("at", F.posexplode("counts").alias("i", "n")).where("n > 0").groupBy((F.col("at") + F.col("i")).alias("g")).agg(F.sum("n").alias("n"))
    out = np.zeros(groups, np.int64)
    with shuffles_removed(texts.sparkSession):
        for g, n in pairs.collect():
            out[g] = n
    return out


def prefixes(texts: DataFrame, width: int, share: tuple[int, int], order) -> DataFrame:
    """(token, point) for the first tokens of each set; equal sets of a batch give theirs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.zeros(0, np.uint64)
            for _, _, data, offsets in pieces(batch.column(1)):
                tokens, first = token_sets(data, offsets, width)
                names = points(first, tokens)
                n = np.diff(first)
                _, at = np.unique(names, return_index=True)
                fresh = np.zeros(len(names), bool)
                fresh[at] = True
                fresh &= (n > 0) & ~np.isin(names, seen)
                seen = np.concatenate([seen, names[fresh]])
                rows = np.repeat(np.arange(len(n)), n)
                keep = fresh[rows]
                tokens, rows = tokens[keep], rows[keep]
                by = np.lexsort((tokens, order.value[(tokens % np.uint64(len(order.value))).astype(np.int64)], rows))
                tokens, rows = tokens[by], rows[by]
                rank = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
                head = rank < (n - needed(n, share) + 1)[rows]
                yield pa.RecordBatch.from_arrays([pa.array(signed(tokens[head])), pa.array(signed(names[rows[head]]))], ["token", "point"])

    return texts.mapInArrow(run, "token bigint, point bigint")


def nodes(prefix_rows: DataFrame) -> DataFrame:
    """(node, point, centre) of the tokens that two points or more share. Tokens with the same points are one node.

    Rows come sorted by token; a token's points are held up to CARRY of them, and beyond that the token itself names the node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_token, held, centre, over = None, np.zeros(0, np.uint64), None, False

        def of(names: np.ndarray, members: np.ndarray, centres: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(signed(names)), pa.array(signed(members)), pa.array(signed(centres))], ["node", "point", "centre"])

        def last() -> Iterator[pa.RecordBatch]:
            if over or len(held) > 1:
                name = np.array([held_token], np.int64).view(np.uint64) if over else mix(mix(held).sum(keepdims=True) + np.uint64(len(held)))
                least = centre if centre is not None else held[np.argmin(mix(held))]
                yield of(np.repeat(name, len(held)), held, np.repeat(least, len(held)))

        for batch in batches:
            if not batch.num_rows:
                continue
            token, point = (batch.column(i).to_numpy() for i in (0, 1))
            point = point.view(np.uint64)
            if held_token is not None:
                same = int(np.searchsorted(token != held_token, True)) if token[0] == held_token else 0
                same = len(token) if token[-1] == held_token else same
                held = np.unique(np.concatenate([held, point[:same]]))
                token, point = token[same:], point[same:]
                if not len(token):
                    if len(held) > CARRY:
                        centre = held[np.argmin(mix(held))] if centre is None else centre
                        name = np.array([held_token], np.int64).view(np.uint64)
                        yield of(np.repeat(name, len(held)), held, np.repeat(centre, len(held)))
                        held, over = held[:0], True
                    continue
                yield from last()
                centre, over = None, False
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (point[1:] != point[:-1])
            token, point = token[new], point[new]
            held_token = token[-1]
            begin = int(np.searchsorted(token, held_token))
            held = point[begin:]
            token, point = token[:begin], point[:begin]
            head = np.ones(len(token), bool)
            head[1:] = token[1:] != token[:-1]
            at = np.flatnonzero(head)
            if len(at):
                group = np.cumsum(head) - 1
                sizes = np.diff(np.append(at, len(token)))
                names = mix(np.add.reduceat(mix(point), at) + sizes.astype(np.uint64))
                least = np.minimum.reduceat(mix(point), at)
                centres = np.zeros(len(at), np.uint64)
                is_least = mix(point) == least[group]
                centres[group[is_least]] = point[is_least]
                keep = sizes[group] > 1
                if keep.any():
                    yield of(names[group][keep], point[keep], centres[group][keep])
        if held_token is not None:
            yield from last()

    rows = prefix_rows.repartition("token").sortWithinPartitions("token", "point")
    return rows.mapInArrow(run, "node bigint, point bigint, centre bigint").dropDuplicates(["node", "point"])


def texts_of(texts: DataFrame, points_table: DataFrame, places: DataFrame) -> DataFrame:
    """component, part, point, packed: one text of each point (each row that repeats its id), at all places (component, part) of the point.

    The ids of those texts are broadcast with their places while there are at most ``MOST_IDS`` of them; beyond that the packed texts are shuffled.
    """
    placed = places.groupBy("point").agg(F.collect_list(F.struct("component", "part")).alias("places"))  # no more than the parts of one block
    wanted = settled(points_table.select("point", "doc_id").join(placed, "point"), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), press_texts(batch.column(2))], ["point", "places", "packed"])

    with shuffles_removed(texts.sparkSession):
        few = wanted.count() <= MOST_IDS
    if few:
        kind = "point bigint, places array<struct<component: bigint, part: bigint>>, packed binary"
        made = texts.join(F.broadcast(wanted), "doc_id").select("point", "places", "text").mapInArrow(run, kind)
    else:
        made = pack(texts).join(wanted, "doc_id")
    return made.select(F.explode("places").alias("place"), "point", "packed").select("place.component", "place.part", "point", "packed")


def bounded(pairs: DataFrame, points_table: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sizes and summed coordinate minima allow a link, and the tokens of both. Only pairs of near sizes get vectors."""
    p, q = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            kept, tokens = [], []
            for i, (m, n, u, v) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)):
                u, v = (np.frombuffer(press.decompress(x), np.uint8) for x in (u, v))
                groups = min(len(u), len(v))
                if (p + q) * int(np.minimum(fold(u, groups), fold(v, groups)).sum()) >= p * (m + n):
                    kept.append(i)
                    tokens.append(m + n)
            if kept:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(tokens, pa.int64())], ["a", "b", "tokens"])

    def of(end: str, *columns: Column) -> DataFrame:
        return points_table.select(F.col("point").alias(end), *columns)

    sized = pairs.join(of("a", F.col("n").alias("m")), "a").join(of("b", F.col("n")), "b")
    near = sized.where(F.least("m", "n") * q >= F.greatest("m", "n") * p)  # sizes too far apart are no candidates
    joined = near.join(of("a", F.col("vector").alias("u")), "a").join(of("b", F.col("vector").alias("v")), "b")
    return joined.select("a", "b", "m", "n", "u", "v").mapInArrow(run, "a bigint, b bigint, tokens bigint")


def verified_by_block(pairs: DataFrame, points_table: DataFrame, texts: DataFrame, width: int, share: tuple[int, int], most_tokens: int, most_pairs: int) -> DataFrame:
    """Enough of the pairs (a, b) whose sets link to connect all that those links connect.

    Points that pairs hold together form a block; a text of each travels to its block once, whatever the number of pairs, and pairs that are
    connected already are passed over. A block with more than ``most_pairs`` pairs, or ``most_tokens`` tokens of them, is dealt by pair to parts of about so many,
    so that no task has a whole large group; a text then travels to the parts that have a pair of it. Large blocks are few and broadcast.
    """
    p, q = share
    blocks = settled(components(pairs.sparkSession, pairs), "blocks")
    placed = settled(pairs.join(blocks, pairs["a"] == blocks["node"]).select("component", "a", "b", "tokens"), "placed")
    parts = F.greatest(F.ceil(F.count("*") / F.lit(most_pairs)), F.ceil(F.sum("tokens") / F.lit(most_tokens))).alias("parts")
    parts = placed.groupBy("component").agg(parts).where("parts > 1")
    part = F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1))).alias("part")
    dealt = settled(placed.join(F.broadcast(parts), "component", "left").select("component", part, "a", "b"), "dealt")
    places = dealt.select("component", "part", F.explode(F.array("a", "b")).alias("point")).distinct()
    members = texts_of(texts, points_table, places).select("component", "part", F.lit(0).alias("kind"), F.col("point").alias("a"), F.lit(None).cast("bigint").alias("b"), "packed")
    inside = dealt.select("component", "part", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("packed"))

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        kind, a, b = table.column(2).to_numpy(), table.column(3).to_numpy(), table.column(4).combine_chunks().fill_null(0).to_numpy()
        held = int(np.searchsorted(kind, 1))
        tokens: dict[int, np.ndarray] = {}
        for at in range(0, held, 64):
            named = a[at : min(at + 64, held)]
            for low, high, data, offsets in pieces(flatten(unpack(table.column(5).slice(at, len(named))))):
                found, first = token_sets(data, offsets, width)
                right = np.flatnonzero(signed(points(first, found)) == named[low:high])
                tokens |= {int(named[low + i]): found[first[i] : first[i + 1]].copy() for i in right.tolist()}
        parent = {x: x for x in tokens}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        linked = []
        for x, y in zip(a[held:].tolist(), b[held:].tolist(), strict=True):
            m, n = root(x), root(y)
            if m != n:
                both = np.concatenate([tokens[x], tokens[y]])
                both.sort(kind="stable")
                if (p + q) * int((both[1:] == both[:-1]).sum()) >= p * len(both):
                    parent[m] = n
                    linked.append((x, y))
        if linked:
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in linked], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from grouped(batches, 2, work)

    rows = members.unionByName(inside).repartition("component", "part").sortWithinPartitions("component", "part", "kind")
    return rows.mapInArrow(run, "a bigint, b bigint")


class Box:
    """A part of the tree: the places of its points, the upper corner of their vectors, their sizes and labels."""

    __slots__ = ("at", "corner", "high", "label", "low", "parts", "rows")

    def __init__(self, at: np.ndarray, vectors: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, parts: list[Box] | None = None):
        self.at, self.parts = at, parts
        if parts is None:
            groups = min(len(vectors[i]) for i in at.tolist())
            self.rows = np.stack([narrow(fold(vectors[i], groups)) for i in at.tolist()])
            self.corner = self.rows.max(0)
            self.low, self.high = int(sizes[at].min()), int(sizes[at].max())
            self.label = int(labels[at[0]]) if (labels[at] == labels[at[0]]).all() else None
        else:
            groups = min(len(x.corner) for x in parts)
            self.rows, self.corner = None, narrow(np.stack([fold(x.corner, groups) for x in parts]).max(0))
            self.low, self.high = min(x.low for x in parts), max(x.high for x in parts)
            self.label = parts[0].label if all(x.label == parts[0].label for x in parts) else None


def pack_boxes(vectors: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, at: np.ndarray) -> Box:
    """Leaves of the points at some places that lie together by size class, label and size; then boxes of boxes."""
    order = at[np.lexsort((sizes[at], labels[at], np.floor(np.log2(np.maximum(sizes[at], 1)))))]
    level = [Box(order[i : i + LEAF], vectors, sizes, labels) for i in range(0, len(order), LEAF)]
    while len(level) > 1:
        level = [Box(np.concatenate([x.at for x in level[i : i + FAN]]), vectors, sizes, labels, level[i : i + FAN]) for i in range(0, len(level), FAN)]
    return level[0]


def tree_pairs(vectors: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, share: tuple[int, int], sides: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs of points with different labels whose bound allows a link; where there are two sides, one point of each."""
    p, q = share
    parts = [np.arange(len(sizes))] if sides is None else [np.flatnonzero(sides == x) for x in np.unique(sides)]
    roots = [pack_boxes(vectors, sizes, labels, at) for at in parts]
    todo = [(roots[0], roots[-1])] if sides is None or len(roots) == 2 else []
    while todo:
        a, b = todo.pop()
        if a.label is not None and a.label == b.label or q * a.high < p * b.low or q * b.high < p * a.low:
            continue
        groups = min(len(a.corner), len(b.corner))
        if (p + q) * int(np.minimum(fold(a.corner, groups), fold(b.corner, groups)).sum()) < p * (a.low + b.low):
            continue
        if a.parts is None and b.parts is None:
            x, y = fold(a.rows, groups), fold(b.rows, groups)
            bound = np.stack([np.minimum(row, y).sum(1, dtype=np.int64) for row in x])  # a row at a time: long vectors need 16 of them here, not 256
            least = p * (sizes[a.at][:, None] + sizes[b.at][None, :])
            good = ((p + q) * bound >= least) & (labels[a.at][:, None] != labels[b.at][None, :])
            if a is b:
                good &= np.arange(len(a.at))[:, None] < np.arange(len(b.at))[None, :]
            yield from zip(a.at[np.nonzero(good)[0]].tolist(), b.at[np.nonzero(good)[1]].tolist(), strict=True)
        elif a is b:
            todo += [(x, y) for i, x in enumerate(a.parts) for y in a.parts[i:]]
        elif b.parts is None or a.parts is not None and len(a.at) >= len(b.at):
            todo += [(x, b) for x in a.parts]
        else:
            todo += [(a, x) for x in b.parts]


def grouped(batches: Iterator[pa.RecordBatch], keys: int, work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Apply work to the rows of each key; rows come sorted by the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if key != held_key and held:
                yield from work(pa.Table.from_batches(held))
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield from work(pa.Table.from_batches(held))


def apart(node_rows: DataFrame, labels: DataFrame, points_table: DataFrame, share: tuple[int, int], block: int) -> DataFrame:
    """Pairs of points that share a node, carry different labels and pass the bounds of the node's tree, and the tokens of both.

    Pairs with a node's centre are not given: they were verified before, so those that carry different labels do not link. Nor do points take part that
    meet no other label in their class of sizes or the next ones.

    Near copies share many nodes. A pair is given in the least of those only: each point carries its least ``HOMES`` nodes, and the least node
    that both lists name is the least that both points are in. Only pairs whose lists name none in common are given wherever they meet.
    A node with more than ``block`` points, or more than ``NODE_TOKENS`` tokens, is dealt to blocks of them; a task has the pairs within one block, or those
    between two.
    """
    p, q = share
    size_class = F.floor(F.log("n") / F.lit(max(math.log(q / p), 1e-3) * 1.0001)).alias("size_class")  # sizes that may link are of one class or of neighbours
    labelled = node_rows.where("point <> centre").select("node", "point").join(labels, "point", "left").join(points_table.select("point", "n"), "point")
    labelled = labelled.select("node", "point", F.coalesce("label", "point").alias("label"), "n", size_class)
    classes = labelled.groupBy("node", "size_class").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    near = Window.partitionBy("node").orderBy("size_class").rangeBetween(-1, 1)  # a row for each size class of a node
    mixed = classes.select("node", "size_class", F.min("least").over(near).alias("least"), F.max("most").over(near).alias("most")).where("least <> most")
    rows = settled(labelled.join(mixed.select("node", "size_class"), ["node", "size_class"]).drop("size_class"), "mixed")
    homes = rows.groupBy("point").agg(F.slice(F.sort_array(F.collect_list("node")), 1, HOMES).alias("homes"))  # a point is in no more nodes than its prefix has tokens
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("n") / F.lit(NODE_TOKENS))).cast("int").alias("blocks")
    large = rows.groupBy("node").agg(blocks).where("blocks > 1")  # few: each has more than so many points or tokens
    rows = rows.join(F.broadcast(large), "node", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.join(points_table.select("point", "vector").join(homes, "point"), "point")
    mine = F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("mine", mine).withColumn("other", other).select(
        "node", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "point", "label", "n", "vector", "homes"
    )

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node, i, j = (table.column(k)[0].as_py() for k in range(3))
        mine, point, label, n = (table.column(k).to_numpy() for k in (3, 4, 5, 6))
        press = zstandard.ZstdDecompressor()
        vectors = [np.frombuffer(press.decompress(x), np.uint8) for x in table.column(7).to_pylist()]
        named = [frozenset(x) for x in table.column(8).to_pylist()]
        a: list[int] = []
        b: list[int] = []

        def made() -> pa.RecordBatch:
            x, y = point[a], point[b]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(n[a] + n[b])], ["a", "b", "tokens"])

        for x, y in tree_pairs(vectors, n, label, share, None if i == j else mine):
            if min(named[x] & named[y], default=node) == node:
                a.append(x)
                b.append(y)
                if len(a) >= PAIRS_AT_ONCE:
                    yield made()
                    a, b = [], []
        if a:
            yield made()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from grouped(batches, 3, work)

    dealt = rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")
    return dealt.mapInArrow(run, "a bigint, b bigint, tokens bigint").distinct()


def tries(node_rows: DataFrame, labels: DataFrame, large: int) -> DataFrame:
    """For each point of a large node and each other label that stands there, ``TRIES`` pairs (a, b) with members of that label at most.

    Every such node names one of its points, so a point has as many to choose from as it has nodes, and takes few of them. So these pairs grow with
    the points, whatever the size of a group, and what they link is not compared in the trees.
    """
    rows = node_rows.select("node", "point").join(labels, "point", "left").select("node", "point", F.coalesce("label", "point").alias("label"))
    by = F.xxhash64("point", "node")
    chosen = rows.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("low"), F.max("label").alias("high"), F.min_by(F.struct("point", "label"), by).alias("of"))
    chosen = chosen.where((F.col("c") > large) & (F.col("low") != F.col("high"))).select("node", F.col("of.point").alias("member"), F.col("of.label").alias("other"))
    met = rows.join(chosen, "node").where("label <> other").select("point", "other", F.struct(F.xxhash64("point", "member").alias("h"), "member").alias("m"))
    few = met.groupBy("point", "other").agg(F.slice(F.sort_array(F.collect_set("m")), 1, TRIES).alias("few"))  # a point is in no more nodes than its prefix has tokens
    pairs = few.select("point", F.explode("few.member").alias("member"))
    return pairs.select(F.least("point", "member").alias("a"), F.greatest("point", "member").alias("b")).distinct()


def similarity_classes(documents: DataFrame, width: int = WIDTH, share: tuple[int, int] = SHARE, groups: int = ORDER_GROUPS, block: int = 4096, block_tokens: int = BLOCK_TOKENS, block_pairs: int = BLOCK_PAIRS, large: int = LARGE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links), text_key."""
    spark = documents.sparkSession
    texts = keyed(documents)
    known = texts.where("doc_id is not null").select("doc_id", "text")
    digest = settled(digests(texts.select("doc_id", "text", "text_key"), width), "digest")
    order = np.argsort(np.argsort(group_order(known, width, groups), kind="stable")).astype(np.int32)
    node_rows = settled(nodes(prefixes(known, width, share, spark.sparkContext.broadcast(order))), "nodes")
    made = digest.where("doc_id is not null and point is not null")
    points_table = made.groupBy("point").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.min("vector").alias("vector"))
    points_table = settled(points_table.join(node_rows.select("point").distinct(), "point"), "points")
    own = texts.where("doc_id is not null").select("doc_id", "text_key", "text")

    def linked_of(pairs: DataFrame) -> DataFrame:
        return settled(verified_by_block(pairs, points_table, own, width, share, block_tokens, block_pairs), "links")

    centres = node_rows.where("point <> centre").select(F.least("point", "centre").alias("a"), F.greatest("point", "centre").alias("b")).distinct()
    links = linked_of(settled(bounded(centres, points_table, share), "pairs"))
    def labels_of(links: DataFrame) -> DataFrame:
        return settled(components(spark, links).withColumnRenamed("node", "point").withColumnRenamed("component", "label"), "labels")

    labels = labels_of(links)
    pairs = settled(bounded(settled(tries(node_rows, labels, large), "tries"), points_table, share), "pairs")
    with shuffles_removed(spark):
        none = pairs.isEmpty()
    if not none:
        links = links.unionByName(linked_of(pairs))
        labels = labels_of(links)
    more = linked_of(settled(apart(node_rows, labels, points_table, share, block), "pairs"))
    linked = components(spark, links.unionByName(more)).withColumnRenamed("node", "point").withColumnRenamed("component", "root")
    digest = digest.drop("vector")
    rooted = digest.join(linked, "point", "left").withColumn("root", F.coalesce("root", "point"))
    least = rooted.where("root is not null and doc_id is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rooted.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).cast("bigint").alias("component_id"), "text_key",
    )


def one_of_each_group(documents: DataFrame, width: int = WIDTH, share: tuple[int, int] = SHARE) -> DataFrame:
    """The documents with the least doc_id of their component, each text once; rows without a doc_id stay. All columns as they were."""
    chosen = similarity_classes(documents, width, share).where("doc_id = component_id").select(F.col("doc_id").alias("chosen id"), F.col("text_key").alias("chosen text")).distinct()
    chosen = settled(chosen, "chosen")
    rows = documents.withColumn("chosen key", F.col("doc_id").cast("bigint")).withColumn("own text", text_key())
    once = rows.join(chosen, (F.col("chosen key") == F.col("chosen id")) & (F.col("own text") == F.col("chosen text")), "left_semi")
    once = once.withColumn("chosen rank", F.row_number().over(Window.partitionBy("chosen key", "own text").orderBy(F.lit(0)))).where(F.col("chosen rank") == 1)
    names = [F.col(f"`{c}`") for c in documents.columns]
    return once.select(*names).unionByName(documents.where(F.col("doc_id").isNull()).select(*names))


def op2_shingle_jaccard_join(spark, folder: str) -> DataFrame:
    return similarity_classes(spark.read.parquet(f"{folder}/documents.parquet"))
