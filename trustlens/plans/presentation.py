"""Tables behind the channel pages: breakdown, penalties, recommendations, prices, list rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlens.functions import pricing as PR
from trustlens.functions import status as ST
from trustlens.functions.scalars import half_even
from trustlens.sources.stored_rows import import_rows, quick_stats, stored_verified

# Shown metrics per category and their base maxima
SHOWN = {
    "quality": {"forward_rate": 15, "cv_views": 12, "reach": 8, "regularity": 7},
    "engagement": {"comments": 15, "er_trend": 10, "reaction_rate": 8, "reaction_stability": 5},
    "reputation": {"age": 7, "premium": 7, "source_diversity": 6},
}
FIELD = {"reaction_stability": "stability", "source_diversity": "source"}


def shown_breakdown(imported: DataFrame) -> DataFrame:
    """Long table (username, category, metric, score, max, value, disabled) of the stored metrics."""
    rows = []
    for category, metrics in SHOWN.items():
        for metric in metrics:
            field = F.col(f"m.{FIELD.get(metric, metric)}")
            maximum = F.coalesce(field["max"], F.lit(0))
            may_be_off = metric in ("comments", "reaction_rate")
            off = (maximum == 0) if may_be_off else F.lit(False)
            value = F.lit(None).cast("double") if metric in ("comments", "er_trend") else field["value"].cast("double")
            rows.append(F.struct(
                F.lit(category).alias("category"), F.lit(metric).alias("metric"),
                F.when(off, 0).otherwise(F.coalesce(field["points"], F.lit(0))).alias("score"),
                maximum.alias("max"), F.when(~off, value).alias("value"), off.alias("disabled"),
            ))
    return imported.where("has_metrics").select("username", F.inline(F.array(*rows)))


def info_metrics(imported: DataFrame) -> DataFrame:
    """Long table of the informational metrics with status and bar length; absent values give no row."""
    def row(category: str, name: str, value: Column, status: Column) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(name).alias("metric"), value.cast("double").alias("value"),
                        status.alias("status"), ST.bar_percent(status).alias("bar_percent"))

    ad, pace, private = F.col("llm_stored.ad_percentage"), F.col("m.posting.posts_per_day"), F.col("m.private_ratio")
    rows = F.array(
        row("quality", "ad_load", ad, ST.ad_load(ad)), row("quality", "activity", pace, ST.activity(pace)),
        row("reputation", "private_links", private, ST.private_share(private)),
    )
    known = F.filter(rows, lambda r: r["value"].isNotNull())
    return imported.where("has_metrics").select("username", F.inline(known))


def estimated_items(score: Column, trust: Column) -> Column:
    """Breakdown guessed from the score alone: metrics get their share, the last one of a category the rest."""
    raw = F.when(trust > 0, score / F.nullif(trust, F.lit(0.0))).otherwise(score.cast("double"))
    share = F.least(F.lit(100.0), raw) / 100
    rows = []
    for category, metrics in SHOWN.items():
        total = (F.lit(sum(metrics.values())) * share).cast("int")
        left = total
        names = list(metrics)
        for metric in names[:-1]:
            points = (F.lit(metrics[metric]) * share).cast("int")
            left = left - points
            rows.append((category, metric, F.least(points, F.lit(metrics[metric])), metrics[metric], total))
        last = names[-1]
        rows.append((category, last, F.least(left, F.lit(metrics[last])), metrics[last], total))
    return F.array(*[
        F.struct(F.lit(c).alias("category"), F.lit(n).alias("metric"), p.alias("score"), F.lit(m).alias("max"), t.alias("category_score"))
        for c, n, p, m, t in rows
    ])


def estimated_breakdown(results: DataFrame) -> DataFrame:
    return results.select("username", F.inline(estimated_items(F.col("score"), F.col("trust_factor"))))


def _penalty(name: Column, multiplier: Column) -> Column:
    return F.struct(multiplier.cast("double").alias("multiplier"), name.alias("name"))


def sorted_penalties(imported: DataFrame) -> DataFrame:
    """Penalties of every row, the strongest first: stored ones, those of the model record, or one estimated band."""
    details = F.coalesce(F.map_entries("m.trust_details"), F.array().cast(
        "array<struct<key:string,value:struct<multiplier:double,score:double,ratio:double,scam_count:int,bad_count:int>>>"))
    stored = F.transform(F.filter(details, lambda e: e["value"]["multiplier"] < 1.0), lambda e: _penalty(e["key"], e["value"]["multiplier"]))
    llm = F.col("llm_stored")
    modelled = F.array_compact(F.array(
        F.when((llm["bot_mult"] < 1.0) & (llm["bot_percentage"] != 0), _penalty(F.lit("bots_in_comments"), llm["bot_mult"])),
        F.when((llm["ad_mult"] < 1.0) & (llm["ad_percentage"] != 0), _penalty(F.lit("ad_load"), llm["ad_mult"])),
    ))
    trust = F.col("trust_factor")
    band = (
        F.when(trust <= 0.3, "critical_risk").when(trust <= 0.5, "high_risk").when(trust <= 0.7, "medium_risk")
        .when(trust < 0.9, "slight_risk").otherwise("minimal_risk")
    )
    known = F.concat(stored, modelled)
    guess = F.array_compact(F.array(F.when(trust < 1.0, _penalty(band, trust))))
    return imported.withColumn("penalties", F.array_sort(F.when(F.size(known) > 0, known).otherwise(guess)))


def detail_base(rows: DataFrame) -> DataFrame:
    """Imported rows with category totals (estimated where nothing is stored), views for the price and rates."""
    imported = import_rows(rows)
    estimate = estimated_items(F.col("score"), F.col("trust_factor"))
    columns, position = {}, 0
    for category, metrics in SHOWN.items():
        first = estimate[position]
        position += len(metrics)
        stored = F.col(f"categories.{category}")
        columns[f"{category}_total"] = F.coalesce(stored["score"], first["category_score"])
        columns[f"{category}_max"] = F.coalesce(stored["max"], F.lit(sum(metrics.values())))
    based = imported.withColumns(columns)
    estimated_reach = F.filter(estimate, lambda i: i["metric"] == "reach")[0]
    reach_points = F.coalesce("m.reach.points", estimated_reach["score"])
    reach_max = F.coalesce("m.reach.max", estimated_reach["max"])
    known = F.nullif(F.greatest("avg_views", F.lit(0)), F.lit(0))
    guessed = PR.estimated_views(F.col("members"), F.col("m.reach.value"), reach_points, reach_max, F.col("score"))
    return PR.with_rates(based.withColumn("views_for_price", F.coalesce(known, guessed)))


def recommendations(based: DataFrame) -> DataFrame:
    """Up to four advice codes per row."""
    def share(category: str) -> Column:
        return F.coalesce(F.col(f"{category}_total") / F.nullif(F.col(f"{category}_max"), F.lit(0)).cast("double") * 100, F.lit(0.0))

    trust, verdict, members = F.col("trust_factor"), F.col("verdict"), F.col("members")
    quality, engagement, reputation = share("quality"), share("engagement"), share("reputation")

    def codes(prefix: str, *tests: tuple[Column, str]) -> Column:
        names = F.array_compact(F.array(*[F.when(test, name) for test, name in tests]))
        return F.when(F.size(names) > 0, F.concat(F.lit(prefix), F.array_join(names, "+")))

    strong = codes("strong:", (quality >= 70, "quality"), (engagement >= 70, "engagement"), (reputation >= 80, "reputation"), (trust >= 0.9, "trust"))
    weak = codes("weak:", (quality < 50, "quality"), (engagement < 50, "engagement"), (reputation < 50, "reputation"), (trust < 0.7, "trust"))
    category = F.col("category")
    segment = (
        F.when(category.isin("CRYPTO", "FINANCE", "REAL_ESTATE", "BUSINESS"), "premium_segment")
        .when(category.isin("TECH", "AI_ML"), "tech_segment")
    )
    final = (
        F.when((verdict == "EXCELLENT") & (trust >= 0.9), "ready").when((verdict == "GOOD") & (trust >= 0.8), "good_choice")
        .when(verdict.isin("HIGH_RISK", "SCAM"), "high_risk")
    )
    size = (
        F.when((members > 100000) & verdict.isin("EXCELLENT", "GOOD"), "large_channel")
        .when((members < 5000) & (F.col("score") >= 70), "small_and_good")
    )
    listed = F.array_compact(F.array(strong, F.when(~verdict.isin("EXCELLENT", "GOOD"), weak), segment, final, size))
    return based.withColumn("recommendations", F.slice(listed, 1, 4))


def channel_details(rows: DataFrame) -> DataFrame:
    """Everything shown for a channel: price, penalties, advice, quick figures, verified flag."""
    full = quick_stats(recommendations(sorted_penalties(PR.with_price(detail_base(rows)))))
    return full.withColumn("verified", stored_verified(F.col("breakdown_json")))


def catalogue_rows(rows: DataFrame) -> DataFrame:
    """List rows: priced from the estimated breakdown, with verified flag, ad status and percentage."""
    estimate = estimated_items(F.col("score"), F.col("trust_factor"))
    reach = F.filter(estimate, lambda i: i["metric"] == "reach")[0]
    views = PR.estimated_views(F.col("members"), F.lit(None).cast("double"), reach["score"], reach["max"], F.col("score"))
    priced = PR.with_price(PR.with_rates(rows.withColumn("views_for_price", views)))
    return priced.withColumn("verified", stored_verified(F.col("breakdown_json")))


def llm_block(imported: DataFrame) -> DataFrame:
    """Model figures per row with a status for each of them."""
    llm = F.col("llm_stored")
    return imported.where("has_answer").select(
        "username", F.coalesce(llm["tier"], F.lit("STANDARD")).alias("tier"), F.coalesce(llm["tier_cap"], F.lit(100)).alias("tier_cap"),
        half_even(F.coalesce(llm["llm_trust_factor"], F.lit(1.0)), 2).alias("llm_trust_factor"),
        llm["ad_percentage"].alias("ad_percentage"), ST.low_is_good(llm["ad_percentage"], 20, 40).alias("ad_status"),
        llm["bot_percentage"].alias("bot_percentage"), ST.low_is_good(llm["bot_percentage"], 20, 50).alias("bot_status"),
        llm["trust_score"].alias("trust_score"), ST.high_is_good(llm["trust_score"], 60, 30).alias("trust_status"),
    )
