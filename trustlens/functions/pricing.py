"""Post prices from views, category, score and trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlens.functions.scalars import clamp, half_even

# Price per thousand views (low, average, high) by category
CPM_RATES = {
    "CRYPTO": (800, 1500, 3000),
    "FINANCE": (650, 1000, 1700),
    "REAL_ESTATE": (500, 850, 1500),
    "BUSINESS": (400, 650, 1200),
    "TECH": (350, 600, 1000),
    "AI_ML": (300, 500, 850),
    "EDUCATION": (200, 350, 600),
    "BEAUTY": (130, 230, 400),
    "HEALTH": (130, 230, 400),
    "TRAVEL": (170, 300, 500),
    "RETAIL": (85, 150, 300),
    "NEWS": (65, 170, 400),
    "ENTERTAINMENT": (35, 85, 170),
    "LIFESTYLE": (100, 200, 400),
    "GAMBLING": (650, 1150, 1700),
    "ADULT": (65, 130, 200),
    "OTHER": (65, 130, 270),
}


def with_rates(channels: DataFrame) -> DataFrame:
    """Attach the rate row of the normalised category (a fixed table of 17 rows, so it is broadcast)."""
    from trustlens.operators.catalogue import normalise_category

    spark = channels.sparkSession
    rates = spark.createDataFrame(
        [(name, *values) for name, values in CPM_RATES.items()],
        "price_category string, cpm_low int, cpm_avg int, cpm_high int",
    )
    labelled = channels.withColumn("price_category", F.coalesce(normalise_category(F.col("category")), F.lit("OTHER")))
    return labelled.join(F.broadcast(rates), "price_category", "left")


def cpm(score: Column, trust: Column, low: Column, avg: Column, high: Column) -> Column:
    """Price per thousand views; interpolated between the rates by the trusted score."""
    e = score * trust
    return (
        F.when(e >= 80, high)
        .when(e >= 70, avg + (high - avg) * (F.lit(0.5) + (e - 70) / 10 * 0.5))
        .when(e >= 55, avg * (F.lit(0.8) + (e - 55) / 15 * 0.2))
        .when(e >= 40, low + (avg - low) * ((e - 40) / 15) * 0.5)
        .otherwise(low * F.greatest(F.lit(0.3), e / 40))
        .cast("int")
    )


def estimated_views(members: Column, reach: Column, reach_points: Column, reach_max: Column, score: Column) -> Column:
    """Mean views from the reach, else from its points, else from 10 %; at least 100."""
    percent = (
        F.when(reach.isNotNull(), clamp(reach, 1.0, 50.0))
        .when(reach_points > 0, reach_points / reach_max * 20).otherwise(F.lit(10.0))
    )
    factor = F.lit(0.7) + score / 100 * 0.6
    views = (members * (percent / 100) * factor).cast("bigint")
    return F.when(members <= 0, 100).otherwise(F.greatest(F.lit(100), views)).cast("bigint")


def with_price(channels: DataFrame) -> DataFrame:
    """Add the price range. Needs score, trust_factor, views_for_price and the rate columns."""
    priced = channels.withColumn(
        "cpm", cpm(F.col("score"), F.col("trust_factor"), F.col("cpm_low"), F.col("cpm_avg"), F.col("cpm_high"))
    ).withColumn("price_center", (F.col("views_for_price") / 1000 * F.col("cpm")).cast("bigint"))
    return priced.withColumns({
        "price_min": F.greatest(F.lit(100), (F.col("price_center") * (1 - 0.10)).cast("bigint")),
        "price_max": F.greatest(F.lit(200), (F.col("price_center") * (1 + 0.10)).cast("bigint")),
        "price_trust": half_even(F.col("trust_factor"), 2),
    })
