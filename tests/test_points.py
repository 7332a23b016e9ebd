"""Points just below, at and above every cut."""

import pytest
from pyspark.sql import functions as F

from trustlens.functions import points as P


def evaluate(spark, values, schema, column):
    frame = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r["p"] for r in frame.orderBy("i").select(column().alias("p"), "i").orderBy("i").collect()]


def test_cv(spark):
    values = [(0.0, 0.0), (9.99, 0.0), (10.0, 0.0), (29.9, 0.0), (30.0, 0.0), (59.9, 0.0), (60.0, 0.0), (99.9, 0.0), (100.0, 3.0), (100.0, 3.01)]
    got = evaluate(spark, values, "v double, f double", lambda: P.cv_points(F.col("v"), F.col("f")))
    assert got == [0, 0, 8, 8, 12, 12, 6, 6, 0, 6]


def test_reach_by_size(spark):
    values = [(200.0, 150), (200.1, 150), (150.0, 150), (150.1, 150), (150.1, 500), (100.1, 500), (130.1, 3000), (80.1, 3000), (120.1, 9000),
              (60.1, 9000), (60.0, 9000), (4.9, 9000), (5.0, 9000), (9.9, 9000), (10.0, 9000), (19.9, 9000), (20.0, 9000), (49.9, 9000), (50.0, 9000)]
    got = evaluate(spark, values, "v double, m long", lambda: P.reach_points(F.col("v"), F.col("m")))
    assert got == [4, 0, 8, 4, 0, 4, 0, 4, 0, 4, 8, 0, 3, 3, 5, 5, 6, 6, 8]


@pytest.mark.parametrize("maximum, expected", [(8, [2, 4, 6, 8, 2, 0]), (13, [3, 6, 10, 13, 4, 0]), (0, [0] * 6)])
def test_reaction_rate(spark, maximum, expected):
    values = [(0.29, 9000), (0.3, 9000), (1.0, 9000), (3.0, 9000), (5.1, 9000), (10.1, 9000)]
    got = evaluate(spark, values, "v double, m long", lambda: P.reaction_points(F.col("v"), F.col("m"), maximum))
    assert got == expected


@pytest.mark.parametrize("maximum, expected", [
    (15, [0, 2, 4, 9, 12, 15, 0]), (18, [0, 3, 5, 11, 14, 18, 0]), (25, [0, 4, 8, 15, 20, 25, 0]), (38, [0, 6, 11, 23, 30, 38, 0])])
def test_forward_rate_small_channel(spark, maximum, expected):
    values = [(0.04,), (0.05,), (0.1,), (0.5,), (1.5,), (3.0,), (15.1,)]
    got = evaluate(spark, values, "v double", lambda: P.forward_points(F.col("v"), F.lit(1000), maximum))
    assert got == expected


def test_forward_rate_cuts_depend_on_size(spark):
    values = [(1.5, 50001), (1.5, 50000), (1.5, 5001), (1.5, 5000), (0.3, 50001), (0.3, 5001), (0.1, 5001)]
    got = evaluate(spark, values, "v double, m long", lambda: P.forward_points(F.col("v"), F.col("m"), 15))
    assert got == [15, 12, 12, 12, 9, 4, 2]


def test_regularity(spark):
    values = [(0.1,), (0.14,), (0.5,), (1.0,), (5.0,), (5.1,), (10.0,), (10.1,), (20.0,), (20.1,)]
    assert evaluate(spark, values, "v double", lambda: P.regularity_points(F.col("v"))) == [0, 3, 5, 7, 7, 5, 5, 3, 3, 1]


def test_comments(spark):
    values = [(0.2, 150, True), (0.49, 150, True), (0.5, 150, True), (0.1, 500, True), (0.99, 500, True), (3.0, 500, True),
              (0.29, 9000, True), (0.3, 9000, True), (1.9, 9000, True), (4.9, 9000, True), (5.0, 9000, True), (9.0, 9000, False)]
    got = evaluate(spark, values, "v double, m long, e boolean", lambda: P.comment_points(F.col("e"), F.col("v"), F.col("m"), 15))
    assert got == [12, 12, 15, 3, 8, 15, 0, 3, 8, 12, 15, 0]


def test_stability(spark):
    values = [(30.0, 0.61), (14.9, 0.3), (15.0, 0.39), (15.0, 0.4), (15.0, 0.6), (80.1, 0.3), (80.0, 0.3), (0.0, 0.3)]
    got = evaluate(spark, values, "v double, t double", lambda: P.stability_points(F.col("v"), F.col("t")))
    assert got == [1, 1, 5, 3, 3, 2, 5, 5]
    stored = evaluate(spark, [(0.0, 0.3)], "v double, t double", lambda: P.stability_points(F.col("v"), F.col("t"), zero_is_missing=False))
    assert stored == [1]


def test_age_premium_source(spark):
    assert evaluate(spark, [(89,), (90,), (179,), (180,), (365,), (729,), (730,)], "v int", lambda: P.age_points(F.col("v"))) == [0, 1, 1, 2, 4, 4, 7]
    premium = evaluate(spark, [(0.5, 0), (0.01, 1), (0.011, 1), (0.021, 1), (0.051, 1)], "r double, c int", lambda: P.premium_points(F.col("r"), F.col("c")))
    assert premium == [0, 1, 3, 4, 7]
    source = evaluate(spark, [(0.9, 0.09), (0.71, 0.1), (0.7, 0.1), (0.5, 0.1)], "s double, r double", lambda: P.source_points(F.col("s"), F.col("r")))
    assert source == [6, 0, 2, 6]


def test_decay_zones(spark):
    values = [(0.1,), (0.2,), (0.3,), (0.95,), (0.96,), (0.98,), (1.02,), (1.04,), (1.05,), (2.0,), (2.1,)]
    got = evaluate(spark, values, "v double", lambda: P.decay_zone(F.col("v")))
    assert got == ["budget_cliff", "suspicious_gap", "healthy_organic", "healthy_organic", "stable", "bot_wall", "bot_wall", "stable",
                   "viral_growth", "viral_growth", "suspicious_growth"]


def test_floating_maxima(spark):
    values = [(True, True), (True, False), (False, True), (False, False)]
    got = evaluate(spark, values, "c boolean, r boolean", lambda: P.floating(F.col("c"), F.col("r"), lambda a, b, c: F.array(F.lit(a), F.lit(b), F.lit(c))))
    assert got == [[15, 8, 15], [20, 0, 18], [0, 13, 25], [0, 0, 38]]
