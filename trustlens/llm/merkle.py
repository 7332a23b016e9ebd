"""Merkle manifest of a table: a hash tree per group of rows, a tree over the groups, and a proof for every row.

1. A leaf is the hash of a row's columns, each written as ``-`` for null or else as its length in bytes, a colon and its value.
2. Leaves are numbered within their group by a range-partitioned sort: place in the sorted part plus the rows of the group in earlier parts, so a
   group with a third of all rows is spread over as many parts as its rows fill. The numbering table has at most one row for each part and group.
3. Every level equijoins its nodes with themselves on computed indices of siblings: XOR 1 in a binary tree, the other slots of the run
   otherwise. Then the rows of slot zero, which know their whole run, emit the parents. Each level is written to the shared folder
   and is ``arity`` times smaller than the one below it; the number of levels follows from the largest group.
4. Paths come down from the root in the same way: a node's path is its own siblings and then its parent's path, joined on (group, index of the
   parent), so a key has at most ``arity`` rows and the leaves take part in one join only.

Everything is DataFrame expressions; digests travel as 32 bytes. The root alone is read by the driver.

Results for odd input: null columns are written as ``-``; empty and very long texts are hashed like others; a null group is a group of its own, before
all others; null keys come first in their group; rows that agree in group and key are ordered by their leaf, and equal rows have the same leaf
and a path of their own; an empty table has no rows and no root; columns that are not hashed are left behind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustlens.llm.components import stored

ARITY = 3
EACH_WRITTEN = 3  # of the levels on the way down
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:binary,after:binary>>"


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts' text, as bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf_of(values: list[Column]) -> Column:
    """Hash of the values, each with its length, so that no two lists of values are written alike."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def group_key(column: Column) -> Column:
    """A text that is never null and sorts null first and then by bytes."""
    return F.coalesce(F.concat(F.lit(":"), column.cast("string")), F.lit("-"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with idx, from 0 in the given order within ``g``, and n, the rows of the group."""
    parts = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    parts = stored(parts.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "sorted")
    spans = parts.groupBy("g", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    spans = spans.select("g", "part", "first", F.coalesce(before, F.lit(0)).alias("start"), F.sum("rows").over(W.partitionBy("g")).alias("n"))
    joined = parts.join(spans, ["g", "part"])
    return joined.withColumn("idx", F.col("start") + F.col("place") - F.col("first")).drop("part", "place", "first", "start")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes of groups that have several, with the digests of their run's other nodes before and after them."""
    slot = F.col("idx") % arity
    out, others = nodes.where("n > 1"), nodes.where("n > 1")
    for step in range(1, arity):
        sibling = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + (slot + step) % arity
        other = others.select("g", F.col("idx").alias("sibling"), F.col("digest").alias(f"other {step}"))
        out = out.withColumn("sibling", sibling).join(other, ["g", "sibling"], "left")
    nothing = F.unhex(F.lit(""))
    found = {step: F.coalesce(F.col(f"other {step}"), nothing) for step in range(1, arity)}
    before = [F.when(slot + step >= arity, d).otherwise(nothing) for step, d in found.items()]
    after = [F.when(slot + step < arity, d).otherwise(nothing) for step, d in found.items()]
    out = out.withColumns({"before": F.concat(*before), "after": F.concat(*after)})
    return out.drop("sibling", *[f"other {step}" for step in found])


def parents(level: DataFrame, arity: int) -> DataFrame:
    """The next level: one node for each run, made by its row of slot zero."""
    zero = level.where(F.col("idx") % arity == 0)
    return zero.select(
        "g", F.floor(F.col("idx") / arity).alias("idx"), F.ceil(F.col("n") / arity).alias("n"), digest(as_text(F.col("digest")), as_text(F.col("after"))).alias("digest")
    )


def grown(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The levels with their siblings, from the leaves on, and of each level the single nodes that are the top of their group."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, tops, nodes = [], [leaves.where("n = 1")], leaves
    while most > 1:
        levels.append(stored(with_siblings(nodes, arity), "level"))
        nodes, most = parents(levels[-1], arity), -(-most // arity)
        tops.append(nodes.where("n = 1"))
    return levels, tops


def descended(levels: list[DataFrame], tops: list[DataFrame], starts: DataFrame, arity: int) -> DataFrame:
    """The leaves with their path up to the start of their group; starts has g and what the tops begin with, path among it."""
    down, kept = None, [c for c in starts.columns if c not in ("g", "path")]
    for k in range(len(tops) - 1, -1, -1):
        here = tops[k].join(starts, "g")
        if down is not None:
            above = down.select("g", F.col("idx").alias("up"), F.col("path").alias("rest"), *kept)
            step = F.array(F.struct("before", "after"))
            under = levels[k].withColumn("up", F.floor(F.col("idx") / arity)).join(above, ["g", "up"])
            under = under.withColumn("path", F.concat(step, F.col("rest"))).drop("up", "rest", "before", "after")
            here = under.unionByName(here)
        down = stored(here, "paths") if k and k % EACH_WRITTEN == 0 else here  # keeps the plan short; these tables are small
    return down


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: digest(as_text(s["before"]), as_text(node), as_text(s["after"])))


def path_digest(path: Column) -> Column:
    """Hash of a path's siblings from the leaf to the root, left to right."""
    return digest(F.concat_ws("", F.transform(path, lambda s: F.concat(as_text(s["before"]), as_text(s["after"])))))


def proofs(table: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", group: str = "source", arity: int = ARITY, extra: dict[str, Column] | None = None) -> DataFrame:
    """key, digest (the leaf), extra columns, path, subroot, root of every row; digests are bytes."""
    extra = extra or {}
    own = lambda c: F.col(f"`{c}`")
    rows = table.select(group_key(own(group)).alias("g"), own(key).alias("key"), leaf_of([own(c) for c in columns]).alias("digest"), *[v.alias(c) for c, v in extra.items()])
    levels, tops = grown(numbered(stored(rows, "leaves"), ["key", "digest"]), arity)
    subroots = reduce(DataFrame.unionByName, [t.select("g", "digest") for t in tops])
    every = F.lit("").alias("g")
    upper = numbered(stored(subroots.select(every, F.col("g").alias("group"), "digest"), "subroots"), ["group"])
    upper_levels, upper_tops = grown(upper, arity)
    top = reduce(DataFrame.unionByName, [t.select("digest") for t in upper_tops]).first()
    root = F.lit(bytes(top[0]) if top else None).cast("binary")
    roots = table.sparkSession.range(1).select(every, F.array().cast(PATH).alias("path"), root.alias("root"))
    starts = stored(descended(upper_levels, upper_tops, roots, arity).select(F.col("group").alias("g"), F.col("digest").alias("subroot"), "path", "root"), "starts")
    return descended(levels, tops, starts, arity).drop("g", "idx", "n")


def verified(found: DataFrame, leaf: str) -> DataFrame:
    """Adds folded_root, recomputed from the named leaf and the path, and whether it is the root."""
    return found.withColumn("folded_root", folded(F.col(leaf), F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf, roots and proof; for even crc32 of doc_id the leaf that is verified is that of a text without its line ends."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    altered = leaf_of([F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in COLUMNS])
    found = verified(proofs(documents, extra={"given": F.when(tampered, altered)}).withColumn("given", F.coalesce("given", "digest")), "given")
    return found.select(
        F.col("key").alias("doc_id"), as_text(F.col("digest")).alias("leaf"), as_text(F.col("subroot")).alias("subroot"), as_text(F.col("root")).alias("root"),
        as_text(path_digest(F.col("path"))).alias("proof_sha256"), as_text(F.col("folded_root")).alias("folded_root"), "verified",
    )


_leaf = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"


def _tree(name: str, leaves: str) -> str:
    """SQL of all nodes, of their siblings, and of each leaf's climb; leaves has s, idx, n, h."""
    return f"""
{name}_nodes AS (
  SELECT s, 0 AS lvl, idx, n, h FROM {leaves}
  UNION ALL
  SELECT s, lvl + 1, idx // {ARITY}, max(n + {ARITY - 1}) // {ARITY}, sha256(string_agg(h, '' ORDER BY idx)) FROM {name}_nodes WHERE n > 1 GROUP BY s, lvl, idx // {ARITY}
), {name}_siblings AS (
  SELECT a.s, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM {name}_nodes a JOIN {name}_nodes b ON a.s = b.s AND a.lvl = b.lvl AND a.idx // {ARITY} = b.idx // {ARITY} WHERE a.n > 1 GROUP BY a.s, a.lvl, a.idx
), {name}_climb AS (
  SELECT s, idx AS leaf_idx, 0 AS lvl, idx, given AS h, '' AS proof FROM {leaves}
  UNION ALL
  SELECT c.s, c.leaf_idx, c.lvl + 1, c.idx // {ARITY}, sha256(b.before || c.h || b.after), c.proof || b.before || b.after FROM {name}_climb c JOIN {name}_siblings b ON c.s = b.s AND c.lvl = b.lvl AND c.idx = b.idx
)"""


#: A byte of the polynomial's remainder is taken bit by bit.
_crc = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END))"""

SQL = f"""
WITH RECURSIVE rows_of AS (
  SELECT doc_id, coalesce(':' || source, '-') AS s, {_leaf.format(text="text")} AS h,
    CASE WHEN doc_id IS NOT NULL AND xor({_crc}, 4294967295::BIGINT) % 2 = 0 THEN {_leaf.format(text="replace(text, chr(10), '')")} ELSE {_leaf.format(text="text")} END AS given
  FROM documents
), leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY s) AS n FROM rows_of
), {_tree("leaf", "leaves").strip()}, subroots AS MATERIALIZED (
  SELECT '' AS s, s AS source, h, h AS given, row_number() OVER (ORDER BY s) - 1 AS idx, count(*) OVER () AS n FROM leaf_nodes WHERE n = 1
), {_tree("top", "subroots").strip()}, ends AS (
  SELECT s, leaf_idx, h, proof FROM leaf_climb QUALIFY row_number() OVER (PARTITION BY s, leaf_idx ORDER BY lvl DESC) = 1
), upper_steps AS (
  SELECT u.source, b.lvl, b.before, b.after FROM subroots u JOIN top_nodes t ON t.lvl >= 0 JOIN top_siblings b ON b.lvl = t.lvl AND b.idx = t.idx
  WHERE t.idx = u.idx // power({ARITY}, t.lvl)::BIGINT
), finish AS (
  SELECT s, leaf_idx, -1 AS lvl, h, proof FROM ends
  UNION ALL
  SELECT f.s, f.leaf_idx, f.lvl + 1, sha256(b.before || f.h || b.after), f.proof || b.before || b.after FROM finish f JOIN upper_steps b ON b.source = f.s AND b.lvl = f.lvl + 1
), done AS (
  SELECT s, leaf_idx, h, proof FROM finish QUALIFY row_number() OVER (PARTITION BY s, leaf_idx ORDER BY lvl DESC) = 1
)
SELECT l.doc_id, l.h AS leaf, u.h AS subroot, r.h AS root, sha256(d.proof) AS proof_sha256, d.h AS folded_root, d.h = r.h AS verified
FROM leaves l JOIN done d ON d.s = l.s AND d.leaf_idx = l.idx JOIN subroots u ON u.source = l.s, (SELECT h FROM top_nodes WHERE n = 1) r
"""
