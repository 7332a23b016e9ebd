"""Projection of the driver's test tables onto the channel schemas.

Every view is a pure function of stored columns. The number of channels and of documents
enter as scalar subqueries, so nothing is pulled through the driver.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlens.constants import CATEGORIES

AS_OF_TEXT = "2024-01-31 00:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF_TEXT}'"


def as_of() -> Column:
    """The fixed point in time that the test data is looked at from."""
    return F.expr(AS_OF_SQL)


class SampleTables:
    """Lazily built views over one test-data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    @property
    def channel_count(self) -> Column:
        return self.raw("events").agg(F.max("user_id") + 1).scalar()

    @property
    def document_count(self) -> Column:
        return self.raw("documents").agg(F.count(F.lit(1))).scalar()

    def _post_base(self) -> DataFrame:
        base = self.raw("events").withColumns({"n": self.channel_count, "docs": self.document_count}).selectExpr(
            "user_id AS channel_id", "event_id AS post_id", "cast(ts AS timestamp) AS ts", "value", "n",
            f"datediff({AS_OF_SQL}, ts) AS age_days", "event_id % docs AS doc_id",
        )
        base = base.withColumn("views", F.expr("""
            CASE WHEN post_id % 45 = 0 THEN 0L
                 WHEN channel_id % 5 = 0 THEN 1000 + (post_id % 3) * 10
                 WHEN channel_id % 5 = 1 THEN 700 + post_id % 600
                 WHEN channel_id % 5 = 2 THEN 200 + floor(value * 20)
                 WHEN channel_id % 5 = 3 THEN 400 + 40 * age_days + post_id % 50
                 ELSE floor(value * 100) END
        """))
        return base.withColumns({
            "forwards": F.expr("""
                CASE WHEN channel_id % 50 = 47 AND post_id % 25 = 0 THEN views + 1
                     ELSE (views * element_at(array(0L, 2L, 5L, 12L, 35L, 60L), int(channel_id % 6) + 1)) div 1000 END
            """),
            "replies": F.expr("post_id % (1 + channel_id % 12)"),
            "r1": F.expr("""
                (views * CASE channel_id % 4 WHEN 0 THEN 30L WHEN 1 THEN 0L WHEN 2 THEN 5 + post_id % 20
                              ELSE 5 + age_days END) div 1000
            """),
            "source_id": F.expr("""
                CASE WHEN post_id % 4 = 0 AND channel_id % 3 = 0
                     THEN CASE WHEN channel_id % 9 = 0 THEN 1000L ELSE 1000 + post_id % 6 END END
            """),
            "suffix": F.expr("""
                CASE WHEN channel_id % 7 = 0 THEN
                 CASE WHEN post_id % 10 < 3 THEN concat(' t.me/+inv', post_id % 97)
                      WHEN post_id % 10 = 3 THEN concat(' t.me/channel', post_id % n) ELSE '' END
                ELSE CASE post_id % 40
                 WHEN 0 THEN concat(' t.me/+inv', post_id % 97)
                 WHEN 1 THEN concat(' t.me/channel', post_id % n)
                 WHEN 2 THEN concat(' @channel', (post_id * 7) % n)
                 WHEN 3 THEN concat(' telegram.me/channel', (post_id * 11) % n)
                 WHEN 4 THEN ' https://example.com/x'
                 WHEN 5 THEN concat(' t.me/joinchat/j', post_id % 31)
                 WHEN 6 THEN ' @helperbot' ELSE '' END END
            """),
        })

    POST_COLUMNS = [
        "channel_id", "post_id", "ts", "views", "forwards", "replies",
        """CASE WHEN channel_id % 11 <> 0 THEN array(
             named_struct('emoji', '👍', 'count', r1),
             named_struct('emoji', '❤', 'count', r1 div 2),
             named_struct('emoji', '🎉', 'count', CASE WHEN views >= 100 THEN post_id % 5 ELSE 0L END)) END AS reactions""",
        """CASE WHEN source_id IS NOT NULL THEN
             named_struct('id', source_id, 'type', 'channel', 'username', concat('channel', source_id % n)) END AS forward_from""",
    ]

    @cached_property
    def posts(self) -> DataFrame:
        """Posts without their text."""
        return self._post_base().selectExpr(*self.POST_COLUMNS)

    @cached_property
    def posts_with_text(self) -> DataFrame:
        """Posts with the text of a document plus the link suffix of the post."""
        documents = self.raw("documents").select("doc_id", F.col("text").alias("body"))
        # texts are large and posts are many: shuffle both, so that the text work is spread over all tasks
        return self._post_base().join(documents.hint("merge"), "doc_id").selectExpr(
            *self.POST_COLUMNS, "concat(body, suffix) AS text"
        )

    @cached_property
    def posts_with_footer(self) -> DataFrame:
        """Posts of which some channels close three out of five with the same line."""
        footer = "\n\nFollow this channel for more: number "
        return self.posts_with_text.withColumn("text", F.when(
            (F.col("channel_id") % 4 == 1) & (F.col("post_id") % 5 < 3),
            F.concat("text", F.lit(footer), F.col("channel_id").cast("string")),
        ).otherwise(F.col("text")))

    @cached_property
    def channels(self) -> DataFrame:
        names = ", ".join(f"'{c}'" for c in CATEGORIES)
        return self.raw("events").select(F.col("user_id").alias("channel_id")).distinct().withColumn(
            "members",
            F.expr("""CASE channel_id % 6 WHEN 0 THEN 100 + channel_id % 100
                        WHEN 1 THEN 200 + (channel_id * 37) % 800
                        WHEN 2 THEN 1000 + (channel_id * 41) % 4000
                        ELSE 5000 + (channel_id * 7919) % 60000 END"""),
        ).selectExpr(
            "channel_id", "concat('channel', channel_id) AS username", "concat('Channel ', channel_id) AS title",
            """CASE channel_id % 6 WHEN 0 THEN '' WHEN 1 THEN concat('Ads: @manager', channel_id)
                 WHEN 2 THEN 'no ads' WHEN 3 THEN concat('contact t.me/owner', channel_id)
                 WHEN 4 THEN concat('promo @adbot', channel_id, 'bot, write to @channel', channel_id)
                 ELSE 'news of the day' END AS description""",
            "members",
            "members + CASE WHEN channel_id % 13 = 0 THEN members div 5 ELSE 0 END AS participants_count",
            """CASE channel_id % 8 WHEN 0 THEN 1L WHEN 1 THEN members * 2 div 1000
                 ELSE members * 30 div 1000 END AS online_count""",
            f"{AS_OF_SQL} - make_dt_interval(int(5 + (channel_id * 53) % 1200)) AS created_at",
            "channel_id % 50 = 49 AS is_scam", "channel_id % 50 = 48 AS is_fake", "channel_id % 10 = 9 AS is_verified",
            "channel_id % 4 <> 0 AS comments_enabled",
            f"""CASE channel_id % 18 WHEN 16 THEN NULL WHEN 17 THEN ''
                 ELSE element_at(array({names}), int(channel_id % 18) + 1) END AS category""",
            "CASE WHEN channel_id % 5 = 0 THEN 'NEWS' END AS category_secondary",
            """named_struct('ad_percentage', int((channel_id * 7) % 101), 'bot_percentage', int((channel_id * 13) % 101),
                 'comment_trust', int((channel_id * 17) % 101), 'is_toxic', channel_id % 20 < 3,
                 'toxic_category', CASE WHEN channel_id % 2 = 0 THEN 'GAMBLING' ELSE 'SCAM' END,
                 'severity', CASE channel_id % 20 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM'
                                  ELSE 'SAFE' END) AS llm""",
        )

    @cached_property
    def audience(self) -> DataFrame:
        return self.raw("orders").withColumn("n", self.channel_count).selectExpr(
            "o_custkey % n AS channel_id", "o_orderkey AS k",
        ).selectExpr(
            "channel_id",
            "k * CASE channel_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 20 ELSE 1000 END AS user_id",
            "concat('user', k) AS username",
            "channel_id % 5 <> 0 AND k % CASE WHEN channel_id % 5 = 1 THEN 10 ELSE 20 END = 0 AS is_premium",
            "k % 401 = 0 AS is_scam", "k % 503 = 0 AS is_fake", "k % 211 = 0 AS is_restricted",
            "k % 97 = 0 AS is_deleted", "k % 61 = 0 AS is_bot",
            """int(CASE WHEN k % 6 = 0 THEN NULL
                 WHEN channel_id % 4 = 1 THEN element_at(array(1, 3, 5), int(k % 3) + 1)
                 ELSE element_at(array(2, 4), int(k % 2) + 1) END) AS dc_id""",
        )

    @cached_property
    def comments(self) -> DataFrame:
        return self.raw("conversations").where("role = 'user'").withColumn("n", self.channel_count).selectExpr(
            "conv_id % n AS channel_id", "conv_id * 100 + turn AS comment_id", "conv_id * 20 AS user_id",
            f"{AS_OF_SQL} - make_dt_interval(0, int(conv_id % 1000), int(turn)) AS ts", "text",
        )

    @cached_property
    def usage_events(self) -> DataFrame:
        return usage_view(self.raw("events"), self.channel_count)

    @cached_property
    def results(self) -> DataFrame:
        """One stored row per channel."""
        return self.channels.withColumns({
            "n": self.channel_count,
            "score": F.expr("int((channel_id * 37) % 101)"),
        }).withColumns({
            "raw_score": F.expr("least(100, score + 5)"),
            "trust_factor": F.expr("round((10 + (channel_id * 29) % 91) / 100D, 2)"),
            "verdict": F.expr("""CASE WHEN score >= 75 THEN 'EXCELLENT' WHEN score >= 55 THEN 'GOOD'
                WHEN score >= 40 THEN 'MEDIUM' WHEN score >= 25 THEN 'HIGH_RISK' ELSE 'SCAM' END"""),
            "status": F.expr("""CASE channel_id % 10 WHEN 0 THEN 'WAITING' WHEN 1 THEN 'ERROR'
                ELSE CASE WHEN score >= 70 THEN 'GOOD' ELSE 'BAD' END END"""),
            "ad_status": F.expr("CASE WHEN channel_id % 4 <> 3 THEN int(channel_id % 4) END"),
            "ad_links": F.expr("transform(sequence(1L, 5L), k -> concat('channel', (channel_id * k + k) % n))"),
            "found_via": F.expr("""CASE WHEN channel_id % 6 = 0 THEN 'user_request'
                ELSE concat('channel', channel_id div 2) END"""),
            "created_at": F.expr(f"{AS_OF_SQL} - make_dt_interval(0, int(channel_id))"),
            "scanned_at": F.expr(f"{AS_OF_SQL} - make_dt_interval(0, int(channel_id))"),
        }).drop("n")

    @cached_property
    def stored(self) -> DataFrame:
        """Result rows with their stored JSON texts: long format for even channels, short format for odd ones."""
        def tenths(k: str) -> str:
            return f"concat(({k}) div 10, '.', ({k}) % 10)"

        def hundredths(k: str) -> str:
            return f"concat(({k}) div 100, '.', lpad(cast(({k}) % 100 AS string), 2, '0'))"

        ch = "channel_id"
        values = {
            "cv": tenths(f"({ch} * 17) % 1300"), "re": tenths(f"({ch} * 23) % 3400"), "rg": tenths(f"({ch} * 11) % 250"),
            "vd": hundredths(f"({ch} * 13) % 200"), "fr": tenths(f"({ch} * 31) % 170"), "ac": tenths(f"({ch} * 7) % 80"),
            "rr": tenths(f"({ch} * 19) % 130"), "rs": tenths(f"({ch} * 9) % 1000"), "tc": hundredths(f"({ch} * 3) % 100"),
            "pv": hundredths(f"{ch} % 8"), "sd": hundredths(f"({ch} * 21) % 101"), "rp": tenths(f"({ch} * 2) % 10"),
            "pl": hundredths(f"({ch} * 41) % 101"), "lt": hundredths(f"({ch} * 3) % 100 + 1"), "nr": hundredths(f"({ch} * 5) % 50"),
            "fo": hundredths(f"({ch} * 37) % 101"), "fp": hundredths(f"{ch} % 12"),
            "es": f"element_at(array('growing', 'stable', 'declining', 'dying', 'always_dead', 'insufficient_data'), int({ch} % 6) + 1)",
            "con": f"CASE WHEN {ch} % 4 <> 0 THEN 'true' ELSE 'false' END", "ron": f"CASE WHEN {ch} % 11 <> 0 THEN 'true' ELSE 'false' END",
            "ver": f"CASE WHEN {ch} % 4 = 2 THEN 'true' ELSE 'false' END",
        }
        rows = self.results.withColumns({f"_{k}": F.expr(v) for k, v in values.items()})
        return rows.selectExpr(
            "*",
            f"""concat_ws(', ', CASE WHEN {ch} % 4 = 0 THEN '"hidden_comments": {{"multiplier": 0.85, "reason": "off"}}' END,
              CASE WHEN {ch} % 3 = 0 THEN '"conviction": {{"multiplier": 0.6, "score": 55}}' END,
              CASE WHEN {ch} % 7 = 0 THEN concat('"private_links": {{"multiplier": 0.5, "ratio": ', _pl, '}}') END,
              CASE WHEN {ch} % 11 = 0 THEN '"scam_network": {{"multiplier": 0.81, "scam_count": 2, "bad_count": 1}}' END,
              '"spam_posting": {{"multiplier": 1.0}}') AS _td""",
        ).selectExpr(
            "*",
            f"""concat('{{"cv_views": {{"value": ', _cv, ', "points": 1, "max": 12}}, "reach": {{"value": ', _re, ', "points": 2, "max": 8}}, "regularity": {{"value": ',
              _rg, ', "points": 3, "max": 7}}, "views_decay": {{"value": ', _vd, ', "points": 0, "max": 0}}, "forward_rate": {{"value": ', _fr,
              ', "points": 4, "max": 15}}, "comments": {{"value": "enabled (avg ', _ac, ')", "points": ', {ch} % 16, ', "max": 15, "avg": ', _ac,
              '}}, "er_trend": {{"status": "', _es, '", "points": 5, "max": 10}}, "reaction_rate": {{"value": ', _rr,
              ', "points": 6, "max": 8}}, "reaction_stability": {{"value": ', _rs, ', "top_concentration": ', _tc,
              ', "points": 3, "max": 5}}, "verified": {{"value": ', _ver, ', "points": 0, "max": 0}}, "age": {{"value": ', ({ch} * 53) % 1200,
              ', "points": 2, "max": 7}}, "premium": {{"value": ', _pv, ', "ratio": ', _pv, ', "count": ', {ch} % 5,
              ', "points": 4, "max": 7}}, "source_diversity": {{"value": ', _sd, ', "points": 6, "max": 6, "repost_ratio": ', _rp,
              '}}, "posting_frequency": {{"posts_per_day": ', _rg, ', "status": "normal"}}, "private_links": {{"private_ratio": ', _pl,
              '}}, "comments_enabled": ', _con, ', "reactions_enabled": ', _ron, ', "trust_details": {{', _td, '}}}}') AS _long""",
            f"""concat('{{"_v": 1, "cv": [', _cv, ', 1], "re": [', _re, ', 2], "rg": [', _rg, ', 3], "vd": [', _vd, ', 0], "fr": [', _fr,
              ', 4], "co": ["enabled (avg ', _ac, ')", ', {ch} % 16, '], "er": {{"status": "', _es, '", "points": 5, "max": 10}}, "rr": [', _rr,
              ', 6], "rs": [', _rs, ', 3], "ve": [', _ver, ', 0], "ag": [', ({ch} * 53) % 1200, ', 2], "pr": ',
              CASE WHEN {ch} % 14 = 7 THEN concat('{{"private_ratio": ', _pl, '}}') ELSE concat('[', _pv, ', 4], "pl": {{"private_ratio": ', _pl, '}}') END,
              ', "sd": [', _sd, ', 6], "po": {{"posts_per_day": ', _rg, ', "status": "normal"}}, "comments_enabled": ', _con,
              ', "reactions_enabled": ', _ron, ', "trust_details": {{', _td, '}}}}') AS _short""",
            f"""CASE WHEN {ch} % 6 <> 5 THEN concat(', "llm_analysis": {{"tier": "STANDARD", "tier_cap": 85, "ad_percentage": ', ({ch} * 7) % 101,
              ', "bot_percentage": ', ({ch} * 13) % 101, ', "trust_score": ', ({ch} * 17) % 101, ', "ad_mult": ',
              CASE WHEN ({ch} * 7) % 101 > 30 THEN '0.9' ELSE '1.0' END, ', "bot_mult": ', CASE WHEN ({ch} * 13) % 101 > 40 THEN '0.8' ELSE '1.0' END,
              ', "llm_trust_factor": ', _lt, '}}') ELSE '' END AS _llm""",
        ).selectExpr(
            *[c for c in self.results.columns],
            f"""CASE WHEN {ch} % 23 <> 22 THEN concat('{{"breakdown": ', CASE WHEN {ch} % 2 = 0 THEN _long ELSE _short END,
              ', "categories": {{"quality": {{"score": ', {ch} % 43, ', "max": 42}}, "engagement": {{"score": ', {ch} % 39,
              ', "max": 38}}, "reputation": {{"score": ', {ch} % 21, ', "max": 20}}}}', CASE WHEN {ch} % 5 = 0 THEN
              concat(', "flags": {{"is_verified": ', CASE WHEN {ch} % 3 = 0 THEN 'true' ELSE 'false' END, '}}') ELSE '' END, _llm, '}}') END AS breakdown_json""",
            f"""CASE WHEN {ch} % 9 <> 0 THEN concat('{{"users_analyzed": ', 20 + {ch} % 80, ', "id_clustering": {{"neighbor_ratio": ', _nr,
              ', "fatality": ', CASE WHEN ({ch} * 5) % 50 > 30 THEN 'true' ELSE 'false' END, '}}, "', CASE WHEN {ch} % 2 = 0 THEN 'geo_dc_check' ELSE 'geo_dc_analysis' END,
              '": {{"foreign_ratio": ', _fo, '}}, "premium_density": {{"premium_ratio": ', _fp, ', "premium_count": ', {ch} % 6, '}}}}') END AS forensics_json""",
            f"CASE WHEN {ch} % 3 <> 0 THEN ({ch} * 101) % 9000 END AS avg_views",
            "llm.ad_percentage AS ad_percentage", "llm.bot_percentage AS bot_percentage",
        )

    @cached_property
    def skip_list(self) -> DataFrame:
        return self.channels.where("channel_id % 17 = 0").selectExpr(
            "username", f"{AS_OF_SQL} + make_dt_interval(int(channel_id % 5 - 2)) AS expires_at",
        )

    @cached_property
    def scan_requests(self) -> DataFrame:
        return self.raw("orders").withColumn("n", self.channel_count).selectExpr(
            "o_orderkey AS request_id", "concat('channel', o_orderkey % (2 * n)) AS username", "cast(o_orderdate AS timestamp) AS requested_at",
        )

    @cached_property
    def favorites(self) -> DataFrame:
        return self.raw("orders").withColumn("n", self.channel_count).selectExpr(
            "o_custkey AS user_id", "concat('channel', o_orderkey % n) AS username", "cast(o_orderdate AS timestamp) AS added_at",
            "o_orderkey AS seq",
        )

    @cached_property
    def answer_texts(self) -> DataFrame:
        """Per turn a clean JSON answer and one of key: value lines."""
        return self.raw("conversations").selectExpr(
            "conv_id AS key", "turn",
            f"{AS_OF_SQL} - make_dt_interval(int(turn * 2)) AS cached_at",
            """concat('{"classification": {"category": "', element_at(array('TECH', 'NEWS', 'CRYPTO', 'MUSIC'), int(conv_id % 4) + 1),
              '"}, "safety": {"status": "', element_at(array('SAFE', 'HIGH', 'MEDIUM', 'CRITICAL', 'SAFE'), int(conv_id % 5) + 1),
              '", "is_scam": ', CASE WHEN conv_id % 7 = 0 THEN 'true' ELSE 'false' END,
              ', "flags": [', element_at(array('', '"online casino"', '"fake shop", "adult"', '"18+ content"'), int(conv_id % 4) + 1),
              ']}, "ad_analysis": {"ad_post_ids": [', substring('1, 2, 3, 4, 5', 1, int(greatest(0, 3 * (conv_id % 6) - 2))),
              ']}, "audience": {"trust_score": ', (conv_id * 17) % 101,
              ', "verdict": "', element_at(array('HIGH_QUALITY', 'MIXED', 'BOT_FARM', 'OTHER'), int(conv_id % 4) + 1),
              '"}, "ad_percentage": ', (conv_id * 7) % 101, ', "ad_post_count": ', (conv_id * 3 + turn) % 60,
              ', "total_comments": ', conv_id % 41, ', "suspicious_bot_count": ', (conv_id + turn) % 20,
              ', "authenticity_tier": "', element_at(array('HIGH', 'MEDIUM', 'LOW', 'ODD'), int((conv_id + turn) % 4) + 1),
              '", "toxic_post_count": ', conv_id % 9, ', "total_posts": ', 20 + conv_id % 30,
              ', "toxic_category": "', element_at(array('GAMBLING', 'null', 'SCAM'), int(conv_id % 3) + 1),
              '", "severity_label": "', element_at(array('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'SAFE'), int(conv_id % 5) + 1),
              '"}') AS clean""",
            """concat('Toxicity: ', conv_id % 10, '\nad_percentage: ', (conv_id * 7) % 101,
              '\n"violence": ', conv_id % 4, '\nred_flags: ["spam", "bots"]') AS lines""",
        )

    @cached_property
    def llm_responses(self) -> DataFrame:
        """Stored model answers: clean JSON, JSON inside prose, key: value lines, or empty."""
        return self.answer_texts.selectExpr(
            "key", "cached_at", "turn",
            """CASE turn % 4 WHEN 0 THEN clean WHEN 1 THEN concat('Here is the answer: ', clean, ' Hope it helps.')
                 WHEN 2 THEN lines ELSE '' END AS response""",
        )

    @cached_property
    def malformed_responses(self) -> DataFrame:
        """The clean answers, each broken in one of ten ways."""
        return self.answer_texts.selectExpr("key", "turn", r"""CASE (key + turn) % 10
            WHEN 0 THEN replace(replace(clean, '}', ',}'), ']', ', ]')
            WHEN 1 THEN replace(clean, '"', "'")
            WHEN 2 THEN concat('Sure: ', substring(clean, 1, length(clean) - 2))
            WHEN 3 THEN regexp_replace(clean, '"([a-z_]+)":', '$1:')
            WHEN 4 THEN replace(replace(concat('{"note": None, ', substring(clean, 2)), 'true', 'True'), 'false', 'False')
            WHEN 5 THEN concat('```json\n', replace(clean, '"safety"', '// see below: "x", y\n "safety"'), '\n``` {"toxicity": 9}')
            WHEN 6 THEN replace(clean, ', "', '\n "')
            WHEN 7 THEN replace(clean, '{"classification": {', '{"classification": {"category_reasoning": "they say "buy\n now", often", ')
            WHEN 8 THEN replace(clean, '": ', '" ')
            ELSE replace(clean, ', "', ',, "') END AS response""")


def usage_view(events: DataFrame, channel_count: Column) -> DataFrame:
    """Usage events; also applied to a stream of the same table."""
    return events.withColumn("n", channel_count).selectExpr(
        "event_id", "cast(ts AS timestamp) AS ts",
        """CASE event_type WHEN 'signup' THEN 'app_open' WHEN 'view' THEN 'channel_view' WHEN 'click' THEN 'search_submit'
             WHEN 'purchase' THEN 'channel_detail' WHEN 'error' THEN 'scan_request' END AS event_type""",
        "CASE WHEN event_id % 50 <> 0 THEN user_id END AS user_id",
        "concat('channel', (event_id * 31) % n) AS username", "floor(value * 10) AS duration_ms",
    )
