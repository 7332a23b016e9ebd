"""Row-level column builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustlens.constants import MEDIUM, MICRO, SMALL, VERDICTS


def steps(value: Column, cuts: list[tuple], otherwise) -> Column:
    """First result whose bound lies strictly above ``value``; NULL values take the last result."""
    (bound, result), *rest = cuts
    out = F.when(value < bound, result)
    for bound, result in rest:
        out = out.when(value < bound, result)
    return out.otherwise(otherwise)


def ladder_down(value: Column, cuts: list[tuple], otherwise, inclusive: bool = True) -> Column:
    """First result whose bound is reached (or exceeded, if not ``inclusive``) by ``value``."""
    def reached(bound) -> Column:
        return value >= bound if inclusive else value > bound

    (bound, result), *rest = cuts
    out = F.when(reached(bound), result)
    for bound, result in rest:
        out = out.when(reached(bound), result)
    return out.otherwise(otherwise)


def by_size(members: Column, micro, small, medium, large) -> Column:
    """Pick a value by member count."""
    return steps(members, [(MICRO, micro), (SMALL, small), (MEDIUM, medium)], large)


def size_class(members: Column) -> Column:
    return by_size(members, "micro", "small", "medium", "large")


def reactions_total(reactions: Column) -> Column:
    """Sum of the reaction counts of a post; a missing array counts as 0."""
    counts = F.coalesce(reactions["count"], F.array().cast("array<bigint>"))
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, c: acc + F.coalesce(c, F.lit(0)))


def positive_reactions(reactions: Column) -> Column:
    """Reactions with a count above zero; a missing emoji becomes ``?``."""
    named = F.transform(
        F.coalesce(reactions, F.array().cast("array<struct<emoji:string,count:bigint>>")),
        lambda r: F.struct(F.coalesce(r["emoji"], F.lit("?")).alias("emoji"), F.coalesce(r["count"], F.lit(0)).alias("count")),
    )
    return F.filter(named, lambda r: r["count"] > 0)


def age_days(created_at: Column, as_of: Column) -> Column:
    """Full days since creation, at least 1; an unknown date counts as a year."""
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(created_at)
    return F.coalesce(F.greatest(F.lit(1), F.floor(seconds / 86400)), F.lit(365)).cast("int")


def cv_from_sums(n: Column, total: Column, squares: Column, sample: bool) -> Column:
    """Coefficient of variation out of count, sum and sum of squares.

    For whole numbers the sums are exact, so the result does not depend on the order of
    the rows. Fewer than two values, or a zero mean, give 0.
    """
    n = n.cast("double")
    total = total.cast("double")
    spread = F.greatest(n * squares.cast("double") - total * total, F.lit(0.0))
    if sample:
        spread = spread * n / F.nullif(n - 1, F.lit(0.0))
    ratio = F.sqrt(spread) / F.nullif(total, F.lit(0.0))
    return F.when(n < 2, F.lit(0.0)).otherwise(F.coalesce(ratio, F.lit(0.0)))


def safe_ratio(top: Column, bottom: Column, scale: float = 1.0, default: float = 0.0) -> Column:
    """top / bottom * scale, or the default where the denominator is zero or missing."""
    quotient = top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))
    return F.coalesce(quotient * F.lit(float(scale)), F.lit(float(default)))


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def normalise_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "^@+", ""))


def valid_name(name: Column) -> Column:
    return name.rlike("^[a-zA-Z][a-zA-Z0-9_]{4,31}$")


def verdict_of(score: Column) -> Column:
    return ladder_down(score, VERDICTS, "SCAM")


def safe_int(text: Column, default: int = 0) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(default))


def safe_double(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(float(default)))


def clamp(value: Column, low, high) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def product(factors: list[Column]) -> Column:
    """Left-to-right product of multiplier columns."""
    out = factors[0]
    for factor in factors[1:]:
        out = out * factor
    return out
