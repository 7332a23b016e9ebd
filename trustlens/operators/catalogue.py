"""Catalogue queries over stored results: filters, pages, histograms, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlens.constants import CATEGORIES, MIN_SCAN_MEMBERS

SORT_COLUMNS = ("score", "members", "trust_factor", "scanned_at")


def catalogue_filter(
    results: DataFrame,
    min_score: int = 0,
    max_score: int = 100,
    min_members: int = 0,
    max_members: int = 2**62,
    min_trust: float = 0.0,
    verdict: str | None = None,
    categories: list[str] | None = None,
    ad_status: list[str] | None = None,
) -> DataFrame:
    """Scored channels within the given ranges; every condition is a plain column predicate that reaches the scan."""
    kept = results.where(
        F.col("status").isin("GOOD", "BAD")
        & F.col("score").between(min_score, max_score)
        & F.col("members").between(min_members, max_members)
        & (F.col("trust_factor") >= min_trust)
    )
    if verdict:
        kept = kept.where(verdict_filter(verdict))
    if categories:
        kept = kept.where(category_filter(categories))
    if ad_status:
        kept = kept.where(ad_status_filter(ad_status))
    return kept


def verdict_filter(verdict: str) -> Column:
    wanted = ["EXCELLENT", "GOOD"] if verdict == "good_plus" else [verdict.upper()]
    return F.col("verdict").isin(wanted)


def category_filter(categories: list[str]) -> Column:
    """A channel matches by its first or second label."""
    wanted = [c.upper() for c in categories]
    return F.col("category").isin(wanted) | F.col("category_secondary").isin(wanted)


def ad_status_filter(values: list[str]) -> Column:
    """Anything that is not a number is ignored; without numbers the filter is off."""
    wanted = [int(v) for v in values if v.strip().isdigit()]
    return F.col("ad_status").isin(wanted) if wanted else F.lit(True)


def catalogue_page(
    filtered: DataFrame, sort_by: str = "score", descending: bool = True, page: int = 1, page_size: int = 30
) -> DataFrame:
    """One page with the total and whether more rows follow.

    Sorting with a limit is planned as a distributed top-k. For pages far into the list use
    ``catalogue_after``, which does not have to rank the rows it skips.
    """
    if sort_by not in SORT_COLUMNS:
        sort_by = "score"
    key = F.col(sort_by).desc_nulls_last() if descending else F.col(sort_by).asc_nulls_first()
    total = filtered.agg(F.count(F.lit(1))).scalar()
    return (
        filtered.orderBy(key, F.col("username")).offset((page - 1) * page_size).limit(page_size)
        .withColumns({"total": total, "has_more": total > page * page_size})
    )


def catalogue_after(filtered: DataFrame, score: int, username: str, page_size: int = 30) -> DataFrame:
    """The page that follows a known last row (score descending, then name)."""
    follows = (F.col("score") < score) | ((F.col("score") == score) & (F.col("username") > username))
    return filtered.where(follows).orderBy(F.col("score").desc(), "username").limit(page_size)


def uncategorised(results: DataFrame, limit: int = 100) -> DataFrame:
    missing = F.col("category").isNull() | (F.col("category") == "")
    return results.where((F.col("status") == "GOOD") & missing).orderBy(F.col("score").desc(), "username").limit(limit)


def completeness(results: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in scope and rows with a non-empty value, one output row per column."""
    def filled(name: str) -> Column:
        return F.count_if(F.col(name).isNotNull() & (F.length(F.col(name).cast("string")) > 0))

    counts = results.agg(F.count(F.lit(1)).alias("rows"), *[filled(c).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("filled")) for c in columns])
    return counts.select("rows", F.inline(pairs)).select("name", "rows", "filled")


def normalise_category(category: Column) -> Column:
    cleaned = F.translate(F.upper(category), "/ ", "__")
    return F.when(cleaned.isin(CATEGORIES), cleaned).otherwise("OTHER")


def status_histogram(results: DataFrame) -> DataFrame:
    """Rows per status, with the total as a row of its own."""
    counts = results.groupBy("status").agg(F.count(F.lit(1)).alias("channels"))
    total = counts.agg(F.lit("total").alias("status"), F.sum("channels").alias("channels"))
    return counts.unionByName(total)


def category_histogram(results: DataFrame) -> DataFrame:
    label = F.coalesce(F.col("category"), F.lit("UNCATEGORIZED"))
    return results.where(F.col("status") == "GOOD").groupBy(label.alias("category")).agg(F.count(F.lit(1)).alias("channels"))


def with_share(histogram: DataFrame) -> DataFrame:
    """Percentage of the total; the total is a scalar, so no global window is needed."""
    total = histogram.agg(F.sum("channels")).scalar()
    return histogram.withColumn("share", F.col("channels") / total * 100)


def crawl_priority(results: DataFrame, limit: int) -> DataFrame:
    """Waiting channels: those a user asked for first, then the oldest."""
    asked = F.when(F.col("found_via") == "user_request", 0).otherwise(1)
    return results.where(F.col("status") == "WAITING").orderBy(asked, "created_at", "username").limit(limit)


def oldest_waiting(results: DataFrame, limit: int) -> DataFrame:
    return results.where(F.col("status") == "WAITING").orderBy("created_at", "username").limit(limit)


def category_prices(results: DataFrame) -> DataFrame:
    """Category histogram with its price range and the totals of labelled and unlabelled channels."""
    from trustlens.functions.pricing import with_rates

    histogram = with_rates(category_histogram(results)).withColumn("categorised", F.col("category") != "UNCATEGORIZED")
    totals = histogram.groupBy("categorised").agg(F.sum("channels").alias("group_total"))
    return histogram.join(totals, "categorised").select(
        "category", "channels", "cpm_low", "cpm_high", "categorised", "group_total"
    )


def large_enough(channels: DataFrame, minimum: int = MIN_SCAN_MEMBERS) -> DataFrame:
    """Channels that are worth analysing at all."""
    return channels.where(F.coalesce("members", F.lit(0)) >= minimum)


def newest_requests(requests: DataFrame, limit: int) -> DataFrame:
    return requests.orderBy(F.col("requested_at").desc(), F.col("request_id").desc()).limit(limit)


def pending_requests(requests: DataFrame, limit: int) -> DataFrame:
    return requests.where(F.col("status") == "pending").orderBy("requested_at", "request_id").limit(limit)
