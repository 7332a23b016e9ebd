"""Bloom filters, and the walk over links that uses them."""

import random

from pyspark.sql import functions as F

from trustlens.functions import bloom
from trustlens.operators.network import reachable


def test_no_key_is_lost_and_few_others_pass(spark, rows):
    keys = spark.range(20_000).select(F.concat(F.lit("name"), "id").alias("k"))
    blocks = bloom.blocks_for(20_000)
    made = bloom.bloom_filter(keys.unionByName(rows([(None,)], "k string")), "k", blocks)
    assert blocks == 8 and made.count() == 8
    asked = spark.range(100_000).select(F.concat(F.lit("name"), "id").alias("k"), F.col("id")).unionByName(rows([(None, -1)], "k string, id long"))
    flagged = bloom.marked(asked, "k", made, blocks, "hit")
    assert flagged.where("id BETWEEN 0 AND 19999 AND NOT hit").count() == 0
    assert flagged.columns == ["k", "id", "hit"] and flagged.where("hit AND id >= 20000").count() < 0.01 * 80_000
    assert flagged.where("k IS NULL AND hit").count() == 0


def test_numbers_and_empty_filters(spark):
    numbers = spark.range(100)
    assert bloom.pruned(numbers, "id", spark.range(10, 13), "id", 3).where("id BETWEEN 10 AND 12").count() == 3
    assert bloom.pruned(numbers, "id", spark.range(0), "id", 0).count() == 0


def test_filters_beyond_the_bound_are_not_made(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MOST_BLOCKS", 0)
    assert bloom.pruned(spark.range(50), "id", spark.range(3), "id", 3).count() == 50


def test_walk_equals_a_plain_one_and_joins_what_it_touches(spark, rows, monkeypatch):
    """A long chain with branches and a hub that everything links: hops are those of a plain walk, and few rows reach the joins."""
    rng = random.Random(3)
    edges = [(f"n{k}", f"n{k + 1}") for k in range(12)] + [(f"n{rng.randrange(13)}", f"m{k}") for k in range(300)] + [(f"m{k}", "hub") for k in range(300)] + [(f"far{k}", f"far{k + 1}") for k in range(3000)]
    edges += [(None, "n3"), ("n2", None), ("n5", "n5")]
    hops, frontier, hop = {"n0": 0}, {"n0"}, 0
    while frontier:
        hop += 1
        frontier = {b for a, b in edges if a in frontier} - set(hops)
        hops |= dict.fromkeys(frontier, hop)
    touched = []
    plain = bloom.pruned

    def counted(big, column, keys, key, count):
        out = plain(big, column, keys, key, count)
        touched.append((column, big.count(), out.count()))
        return out

    monkeypatch.setattr("trustlens.operators.network.pruned", counted)
    found = reachable(rows(edges, "src string, dst string"), rows([("n0",)], "username string"))
    assert {r["username"]: r["hop"] for r in found.collect()} == hops
    assert sum(t[2] for t in touched if t[0] == "src") < 2 * len(edges) < 0.2 * sum(t[1] for t in touched if t[0] == "src")
