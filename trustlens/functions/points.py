"""Metric values to points. Column builders; maxima are literals, so the rounded points are too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustlens.constants import FLOATING_MAX, LARGE, MEDIUM, MICRO, MIN_ACCOUNTS, SMALL
from trustlens.functions.scalars import by_size, ladder_down, steps


def cv_points(cv: Column, forward_rate: Column) -> Column:
    viral = F.when(forward_rate > 3.0, 6).otherwise(0)
    return F.when(cv < 10, 0).when(cv < 30, 8).when(cv < 60, 12).when(cv < 100, 6).otherwise(viral)


def reach_points(reach: Column, members: Column) -> Column:
    fake = by_size(members, 200, 150, 130, 120)
    high = by_size(members, 150, 100, 80, 60)
    return (
        F.when(reach > fake, 0).when(reach > high, 4)
        .otherwise(steps(reach, [(5, 0), (10, 3), (20, 5), (50, 6)], 8))
    )


def reaction_points(rate: Column, members: Column, maximum: int) -> Column:
    fake = steps(members, [(MICRO, 20), (SMALL, 12)], 10)
    high = steps(members, [(MICRO, 15), (SMALL, 8)], 5)
    normal = steps(rate, [(0.3, round(maximum * 0.2)), (1, round(maximum * 0.5)), (3, round(maximum * 0.8))], maximum)
    return F.when(rate > fake, 0).when(rate > high, round(maximum * 0.3)).otherwise(normal)


def forward_points(rate: Column, members: Column, maximum: int) -> Column:
    def cut(huge: float, large: float, other: float) -> Column:
        return F.when(members > LARGE, huge).when(members > MEDIUM, large).otherwise(other)

    return (
        F.when(rate > 15, 0)
        .when(rate >= cut(1.5, 2.0, 3.0), maximum)
        .when(rate >= cut(0.7, 1.0, 1.5), round(maximum * 0.8))
        .when(rate >= cut(0.3, 0.5, 0.5), round(maximum * 0.6))
        .when(rate >= cut(0.1, 0.2, 0.1), round(maximum * 0.3))
        .when(rate >= 0.05, round(maximum * 0.15))
        .otherwise(0)
    )


def regularity_points(posts_per_day: Column) -> Column:
    p = posts_per_day
    return (
        F.when(p < 0.14, 0).when(p < 0.5, 3).when(p < 1.0, 5).when(p <= 5.0, 7)
        .when(p <= 10.0, 5).when(p <= 20.0, 3).otherwise(1)
    )


def comment_points(enabled: Column, average: Column, members: Column, maximum: int) -> Column:
    def band(cuts: list[tuple[float, float]]) -> Column:
        return steps(average, [(bound, round(maximum * share)) for bound, share in cuts], maximum)

    banded = (
        F.when(members < MICRO, band([(0.01, 0), (0.05, 0.3), (0.2, 0.6), (0.5, 0.8)]))
        .when(members < SMALL, band([(0.1, 0), (0.3, 0.2), (1, 0.5), (3, 0.8)]))
        .otherwise(band([(0.3, 0), (0.5, 0.2), (2, 0.5), (5, 0.8)]))
    )
    return F.when(enabled, banded).otherwise(0)


def er_trend_points(status: Column) -> Column:
    return (
        F.when(status == "insufficient_data", 5).when(status == "growing", 10)
        .when(status == "stable", 7).when(status == "declining", 3).otherwise(0)
    )


def stability_points(cv: Column, top_share: Column, zero_is_missing: bool = True) -> Column:
    """In the scan profile a variation of exactly 0 is read as missing, which counts as 50."""
    if zero_is_missing:
        cv = F.coalesce(F.nullif(cv, F.lit(0.0)), F.lit(50.0))
    return (
        F.when(top_share > 0.60, 1).when(cv < 15, 1).when(cv > 80, 2).when(top_share < 0.40, 5).otherwise(3)
    )


def age_points(days: Column) -> Column:
    return steps(days, [(90, 0), (180, 1), (365, 2), (730, 4)], 7)


def age_status(days: Column) -> Column:
    return steps(days, [(90, "newborn"), (180, "young"), (365, "mature"), (730, "established")], "veteran")


def premium_points(ratio: Column, count: Column) -> Column:
    return F.when(count == 0, 0).otherwise(ladder_down(ratio, [(0.05, 7), (0.02, 4), (0.01, 3)], 1, inclusive=False))


def source_points(share: Column, repost_ratio: Column) -> Column:
    return F.when(repost_ratio < 0.10, 6).when(share > 0.7, 0).when(share > 0.5, 2).otherwise(6)


def verified_points() -> Column:
    return F.lit(0)


def decay_zone(ratio: Column) -> Column:
    return (
        F.when(ratio.between(0.3, 0.95), "healthy_organic")
        .when(ratio.between(1.05, 2.0), "viral_growth")
        .when(ratio.between(0.98, 1.02), "bot_wall")
        .when(ratio < 0.2, "budget_cliff")
        .when((ratio > 0.95) & (ratio < 1.05), "stable")
        .when((ratio >= 0.2) & (ratio < 0.3), "suspicious_gap")
        .when(ratio > 2.0, "suspicious_growth")
        .otherwise("unknown")
    )


def floating(comments_on: Column, reactions_on: Column, build: Callable[[int, int, int], Column]) -> Column:
    """Pick the expression built for the maxima that apply with comments or reactions off."""
    def case(comments: bool, reactions: bool) -> Column:
        return build(*FLOATING_MAX[(comments, reactions)])

    return (
        F.when(comments_on & reactions_on, case(True, True))
        .when(comments_on, case(True, False))
        .when(reactions_on, case(False, True))
        .otherwise(case(False, False))
    )


def scoring_mode(accounts: Column) -> Column:
    return F.when(accounts >= MIN_ACCOUNTS, "normal").otherwise("hardcore")
