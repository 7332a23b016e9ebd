"""Predicates, joins, top-k and set operations over stored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.queries import Query
from trustlens.functions import pricing as PR
from trustlens.functions import scalars as S
from trustlens.operators import audience as A
from trustlens.operators import catalogue as C
from trustlens.operators import channel_metrics as M
from trustlens.operators import lifecycle as L
from trustlens.operators import network as N
from trustlens.operators import text_corpus as T
from trustlens.operators import usage as U
from trustlens.operators.page_index import build_page_index, indexed_page
from trustlens.plans import presentation as PS
from trustlens.session import scratch_dir
from trustlens.sources import bucketed
from trustlens.sources import stored_rows as R
from trustlens.sources.samples import as_of

QUERIES: dict[str, Query] = {}


def query(name: str):
    def add(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return add


def stamp(name: str, alias: str | None = None):
    return F.unix_timestamp(name).alias(alias or name)


@query("FLT-01")
def _(t):
    raw = t.results.select("channel_id", F.concat(F.lit("@@"), F.upper("username")).alias("raw"))
    return raw.select("channel_id", S.normalise_name(F.col("raw")).alias("username"))


@query("FLT-02")
def _(t):
    names = t.raw("customer").select(F.explode(F.array("c_name", F.translate("c_name", "#", "_"), "c_mktsegment")).alias("name"))
    return names.select("name", S.valid_name(F.col("name")).alias("valid"))


@query("FLT-03")
def _(t):
    return C.catalogue_filter(t.results, 20, 90, 500, 50000, 0.3).select("username", "score", "members", "trust_factor")


@query("FLT-04")
def _(t):
    return C.catalogue_filter(t.results, verdict="good_plus").select("username", "verdict")


@query("FLT-05")
def _(t):
    return C.catalogue_filter(t.results, categories=["news", "tech"]).select("username", "category", "category_secondary")


@query("FLT-06")
def _(t):
    return C.catalogue_filter(t.results, ad_status=["2", "x", "0"]).select("username", "ad_status")


@query("FLT-07")
def _(t):
    kept = C.catalogue_filter(t.results, 40, 100, 200, verdict="good_plus", categories=["NEWS", "CRYPTO"], ad_status=["1", "2"])
    return kept.agg(F.count(F.lit(1)).alias("channels"))


@query("FLT-08")
def _(t):
    return C.uncategorised(t.results, 20).select("username", "score")


@query("FLT-09")
def _(t):
    # every seventh channel has lost its texts
    return R.without_posts(t.results, t.posts_with_text.where("channel_id % 7 <> 3")).select("username")


@query("FLT-09b")
def _(t):
    return R.without_posts(t.results, t.posts_with_text).select("username")


@query("FLT-10")
def _(t):
    content = T.stored_content(t.posts_with_text, t.comments, t.audience)
    return R.with_content(t.results, content).select("username", "status")


@query("FLT-11")
def _(t):
    return R.without_forensics(t.stored).select("username")


@query("FLT-12")
def _(t):
    return C.completeness(t.results, ["category", "category_secondary", "description", "ad_status", "title"])


@query("FLT-13")
def _(t):
    text = F.col("o_orderpriority")
    return t.raw("orders").select(
        "o_orderkey", S.safe_int(F.substring(text, 1, 1)).alias("number"), S.safe_int(text, -1).alias("fallback"),
        S.safe_double(F.concat(F.substring(text, 1, 1), F.lit(".5"))).alias("decimal"), S.safe_double(text, 1.0).alias("neutral"),
    )


@query("FLT-14")
def _(t):
    label = F.lower(F.translate("category", "_", "/"))
    return t.channels.select("channel_id", F.coalesce(C.normalise_category(label), F.lit("OTHER")).alias("category"))


@query("FLT-15")
def _(t):
    return t.stored.select("username", R.stored_verified(F.col("breakdown_json")).alias("is_verified"))


@query("FLT-16")
def _(t):
    return C.large_enough(t.channels).select("channel_id", "members")


@query("FLT-17")
def _(t):
    return M.dated_posts(t.posts, require_views=True).select("channel_id", "post_id", "age_rank")


@query("FLT-18")
def _(t):
    return T.prompt_corpus(t.posts_with_footer, t.comments, F.md5).select("channel_id", "kind", "slot", F.col("body").alias("body_md5"))


@query("JOIN-01")
def _(t):
    ids = t.channels.select((F.col("channel_id") + 1000).alias("channel_id"), "username")
    return N.forward_sources(t.posts, ids).select("post_id", "source_id", "source_username")


@query("JOIN-02")
def _(t):
    return T.comments_with_premium(t.comments, t.audience).select("channel_id", "comment_id", "is_premium")


@query("JOIN-03")
def _(t):
    sparse = t.audience.where("user_id % 37 = 0")
    return A.supplemented(sparse, t.audience, t.comments).groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("accounts"), F.count_if("supplement").alias("supplements")
    )


@query("JOIN-03b")
def _(t):
    return A.supplemented(t.audience, t.audience, t.comments).groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("accounts"), F.count_if("supplement").alias("supplements")
    )


def requested(t):
    return t.scan_requests.select("username", F.lit("user_request").alias("found_via"))


@query("JOIN-04")
def _(t):
    return L.new_names(t.results, requested(t))


@query("JOIN-05")
def _(t):
    return L.relabel_requested(t.results, t.scan_requests).select("username", "status", "found_via")


@query("JOIN-06")
def _(t):
    return L.not_skipped(t.channels.select("username"), t.skip_list, as_of())


@query("JOIN-07")
def _(t):
    added = t.channels.where("channel_id % 34 = 0")
    return L.skipped_until(t.skip_list, added, as_of(), 7).select("username", stamp("expires_at"))


def rescored(t):
    return t.results.where("channel_id % 3 <> 0").select(
        "username", F.expr("least(100, score + 7)").alias("score"), F.lit("GOOD").alias("status"),
        F.when(F.col("channel_id") % 2 == 0, F.lit("TECH")).alias("category"),
    )


@query("JOIN-08")
def _(t):
    return L.complete_waiting(t.results, rescored(t), ["status", "score"], ["category"]).select(
        "username", "status", "score", "category", "written")


@query("JOIN-08b")
def _(t):
    """The completion of JOIN-08 on a stored table in buckets."""
    home = scratch_dir(t.spark, "bucketed")
    bucketed.store(t.results, home, "username", 16)
    complete = lambda rows: L.complete_waiting(rows, rescored(t), ["status", "score"], ["category"])
    return bucketed.merged(t.spark, home, complete).select("username", "status", "score", "category", "written")


@query("JOIN-09")
def _(t):
    return N.neighbour_risk(t.results)


@query("JOIN-10")
def _(t):
    return N.discovered(t.posts_with_text, t.channels, t.results.where("channel_id % 3 <> 1"))


@query("JOIN-10b")
def _(t):
    edges = t.results.select(F.col("username").alias("src"), F.explode("ad_links").alias("dst"))
    return N.reachable(edges, t.results.where("channel_id = 1"), 3)


@query("JOIN-10c")
def _(t):
    return N.discovered(t.posts_with_text, t.channels, t.results)


@query("JOIN-10d")
def _(t):
    edges = t.results.select(F.col("username").alias("src"), F.explode("ad_links").alias("dst"))
    return N.reachable(edges, t.results.where("status = 'GOOD'"))


@query("JOIN-11")
def _(t):
    active, heavy, spam = M.posting_tier(F.col("category"))
    return PR.with_rates(t.channels).select(
        "channel_id", "price_category", "cpm_low", "cpm_avg", "cpm_high",
        active.alias("active_at"), heavy.alias("heavy_at"), spam.alias("spam_at"),
    )


@query("JOIN-12")
def _(t):
    m = F.col("members")
    return t.channels.select(
        "channel_id", S.by_size(m, 250, 180, 150, 130).alias("reach_limit"), S.by_size(m, 0.8, 0.5, 0.3, 0.15).alias("expected_reach")
    )


@query("JOIN-13")
def _(t):
    keys = t.raw("conversations").select(F.col("conv_id").alias("key")).distinct()
    return L.cached_answers(keys, t.llm_responses, as_of()).select("key", "hit", "turn")


@query("JOIN-14")
def _(t):
    queue = L.queue_positions(t.results.where("status = 'WAITING'").select("username", "created_at"), "created_at", "username")
    return L.triage(t.scan_requests, t.results, queue)


@query("JOIN-15")
def _(t):
    return R.patch_premium(R.import_rows(t.stored)).select(
        "username", F.round("m.premium.ratio", 4).alias("ratio"), F.col("m.premium.count").alias("count"))


@query("TOP-01")
def _(t):
    return C.catalogue_page(C.catalogue_filter(t.results), "members", True, 2, 15).select(
        "username", "members", "total", "has_more")


@query("TOP-01b")
def _(t):
    return C.catalogue_after(C.catalogue_filter(t.results), 60, "channel9", 15).select("username", "score")


@query("TOP-01c")
def _(t):
    """A late page by the index of cells."""
    home = scratch_dir(t.spark, "pages")
    build_page_index(C.catalogue_filter(t.results), home, "members", True, cell_rows=20)
    return indexed_page(t.spark, home, 3, 15).select("username", "members", "total", "has_more")


@query("TOP-01d")
def _(t):
    """Every customer's row by account balance: a page in the middle of a long list."""
    rows = t.raw("customer").select(F.col("c_name").alias("username"), F.floor("c_acctbal").alias("score"))
    home = scratch_dir(t.spark, "pages")
    build_page_index(rows, home, "score", False, cell_rows=500)
    return indexed_page(t.spark, home, 5, 20)


@query("TOP-02")
def _(t):
    return C.crawl_priority(t.results, 10).select("username", "found_via")


@query("TOP-03")
def _(t):
    return C.oldest_waiting(t.results, 5).select("username")


@query("TOP-04")
def _(t):
    return U.top_channels(U.recent(t.usage_events, as_of(), 7))


@query("TOP-05")
def _(t):
    return PS.sorted_penalties(R.import_rows(t.stored)).select(
        "username", F.array_join(F.transform("penalties", lambda p: F.concat_ws(":", p["name"], F.format_number(p["multiplier"], 2))), ",").alias("penalties"))


@query("TOP-06")
def _(t):
    return A.first_flagged(t.audience).select("channel_id", "position", "user_id", F.array_join("flags", ",").alias("flags"))


@query("TOP-07")
def _(t):
    return PS.recommendations(PS.detail_base(t.stored)).select("username", F.size("recommendations").alias("n"), F.array_join("recommendations", ",").alias("codes"))


@query("TOP-08")
def _(t):
    return C.newest_requests(t.scan_requests, 25).select("request_id", "username")


@query("TOP-09")
def _(t):
    return C.category_histogram(t.results).orderBy(F.col("channels").desc(), "category").limit(5)


@query("SET-01")
def _(t):
    return N.outgoing_links(t.posts_with_text, t.channels).select("channel_id", "link")


@query("SET-02")
def _(t):
    return M.private_codes(t.posts_with_text)


@query("SET-03")
def _(t):
    candidates = L.seeds(t.channels).unionByName(L.seeds(t.scan_requests))
    return L.new_names(t.results.where("channel_id % 2 = 0"), candidates)


@query("SET-03b")
def _(t):
    return L.new_names(t.results, L.seeds(t.channels).unionByName(L.seeds(t.scan_requests)))


@query("SET-04")
def _(t):
    gone = t.skip_list.select("username")
    kept = L.remove_keys(t.results, gone, ["username"], only_waiting=True).select("username", F.lit("results").alias("side"))
    favorites = L.remove_keys(
        L.latest_by_key(t.favorites, ["user_id", "username"], ["added_at", "seq"]), gone.join(t.favorites.select("user_id", "username"), "username"),
        ["user_id", "username"],
    ).select("username", F.lit("favorites").alias("side"))
    return kept.unionByName(favorites).groupBy("side", "username").agg(F.count(F.lit(1)).alias("rows"))
