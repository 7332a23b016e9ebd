"""Which pairs of points are compared, and what travels for them."""

import numpy as np

from trustlens.llm import jaccard_join as J

SETS = {1: range(100), 2: range(2, 102), 3: range(4, 104), 4: range(60)}


def table_of(spark):
    def pressed(tokens):
        return J.zstandard.ZstdCompressor().compress(J.vector(J.mix(np.array(list(tokens), np.uint64))).tobytes())

    return spark.createDataFrame([(p, p, len(t), pressed(t)) for p, t in SETS.items()], "point long, doc_id long, n long, vector binary")


def test_pairs_of_a_node_are_neither_those_with_its_centre_nor_far_apart_in_size(spark):
    node_rows = spark.createDataFrame([(9, p, 1) for p in (1, 2, 3, 4)] + [(8, p, 2) for p in (2, 4)], "node long, point long, centre long")
    labels = spark.createDataFrame([], "point long, label long")
    assert [tuple(r) for r in J.apart(node_rows, labels, table_of(spark), (3, 4), 4096).collect()] == [(2, 3, 200)]


def test_vectors_travel_for_pairs_of_near_sizes_alone(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 4), (3, 4), (2, 3)], "a long, b long")
    found = J.bounded(pairs, table_of(spark), (3, 4))
    assert sorted(map(tuple, found.collect())) == [(1, 2, 200), (2, 3, 200)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan[: plan.index("least(")].count("Join") == 3  # the filter by size stands below both joins with vectors


def test_texts_are_packed_and_not_shuffled_before_they_go_to_their_parts(spark):
    texts = spark.createDataFrame([(p, f"text of {p}") for p in SETS], "doc_id long, text string")
    places = spark.createDataFrame([(5, 0, 1), (5, 1, 1), (6, 0, 3)], "component long, part long, point long")
    made = J.texts_of(texts, table_of(spark), places)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    rows = made.collect()
    found = J.unpack(J.pa.array([r["packed"] for r in rows]))
    assert sorted((r["component"], r["part"], r["point"], t) for r, t in zip(rows, found, strict=True)) == [(5, 0, 1, b"text of 1"), (5, 1, 1, b"text of 1"), (6, 0, 3, b"text of 3")]
