"""Pairs of a large group that are tried before its trees are compared."""

from collections import Counter

from trustlens.llm import jaccard_join as J


def test_tries_grow_with_the_points(spark):
    for size in (100, 200):
        members = [(node, point, 0) for node in range(30) for point in range(size)] + [(99, 1, 0), (99, 500, 0)]
        node_rows = spark.createDataFrame(members, "node long, point long, centre long")
        labels = spark.createDataFrame([(p, 0) for p in range(size // 2)], "point long, label long")  # the others stand alone
        pairs = [tuple(r) for r in J.tries(node_rows, labels, 64).collect()]
        own = {p: 0 if p < size // 2 else p for p in range(size)}
        assert pairs and len(pairs) == len(set(pairs)) and all(a < b and own[a] != own[b] for a, b in pairs)
        assert len(pairs) <= 30 * size  # one member of each node, not all pairs
        assert max(Counter(a for a, b in pairs if a < size // 2).values()) <= size
    assert J.tries(node_rows, labels, 1000).isEmpty()  # small nodes have none
