"""Traffic-light status of shown values. Codes only; wording is left to the reader of the table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def low_is_good(value: Column, good: float, warning: float) -> Column:
    return F.when(value <= good, "good").when(value <= warning, "warning").otherwise("bad")


def high_is_good(value: Column, good: float, warning: float) -> Column:
    return F.when(value >= good, "good").when(value >= warning, "warning").otherwise("bad")


def brand_safety(value: Column) -> Column:
    return high_is_good(value, 80, 60)


def banded(value: Column, bands: list[tuple[float, float, str]]) -> Column:
    """Status of the half-open band that holds the value; values outside all bands are a warning."""
    out = F.when(F.lit(False), "warning")
    for low, high, status in bands:
        out = out.when((value >= low) & (value < high), status)
    return out.otherwise("warning")


def ad_load(value: Column) -> Column:
    return banded(value, [(0, 10, "good"), (10, 30, "warning"), (30, 100, "bad")])


def activity(value: Column) -> Column:
    bands = [(0, 0.14, "bad"), (0.14, 0.5, "warning"), (0.5, 8, "good"), (8, 15, "warning"), (15, float("inf"), "bad")]
    return banded(value, bands)


def private_share(value: Column) -> Column:
    return banded(value, [(0, 0.2, "good"), (0.2, 0.5, "warning"), (0.5, 1.0, "bad")])


def bar_percent(status: Column) -> Column:
    return F.when(status == "good", 100).when(status == "warning", 60).otherwise(20)
