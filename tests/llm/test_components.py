"""Components of links against a plain union of sets: chains, hot nodes, repeated and looped links, none at all."""

import numpy as np
import pytest

from trustlens.llm.components import components, contracted, forest


def least_of(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in list(parent))


CHAIN = [(i, i + 1) for i in range(300)]
MIXED = [tuple(x) for x in np.random.default_rng(5).integers(-300, 300, (200, 2)).tolist()] + [(5, i) for i in range(1000, 1300)] * 2
ODD = [(1, 1), (None, 4), (7, None), (2, 3), (3, 2), (2**63 - 1, -(2**63))]


@pytest.mark.parametrize("links", [[], CHAIN, MIXED, ODD])
def test_components(spark, links):
    frame = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    assert sorted(map(tuple, components(spark, frame).collect())) == least_of(links)


@pytest.mark.parametrize("most", [4, 50, 1 << 20])
def test_contraction_keeps_what_is_connected(spark, most):
    links = [(a, b) for a, b in MIXED if a != b]
    made = [tuple(r) for r in contracted(spark.createDataFrame(links, "a bigint, b bigint").coalesce(2), most).collect()]
    assert least_of(made) == least_of(links)
    assert all(a > b for a, b in made)


def test_forest_of_long_chains():
    n = 100_000
    order = np.random.default_rng(1).permutation(n).astype(np.int64)
    a, b = forest(order[:-1], order[1:])
    assert len(a) == n - 1 and not b.any()
    assert [len(x) for x in forest(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


@pytest.mark.parametrize("links", [CHAIN, MIXED, ODD])
def test_components_of_many_tasks(spark, links):
    frame = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    assert sorted(map(tuple, components(spark, frame, 100).collect())) == least_of(links)


def test_few_links_take_few_jobs(spark):
    frame = spark.createDataFrame(CHAIN + MIXED, "a bigint, b bigint").repartition(7)
    spark.sparkContext.setJobGroup("few links", "")
    try:
        components(spark, frame)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 6
    finally:
        spark.sparkContext.setJobGroup("", "")
