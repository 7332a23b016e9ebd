"""What the text jobs move: texts are read, cut and reduced where they lie, and only numbers and digests are shuffled."""

import hashlib
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trustlens.functions.text import TYPE_KEYWORDS, keyword_mask
from trustlens.operators import text_corpus as T

POSTS = "channel_id long, post_id long, ts timestamp, text string"


def channel_posts(rows):
    data = [(1, i, datetime(2024, 1, 30) - timedelta(hours=9 * i), f"post number {i} " + "pqrst"[i % 5] * 60 + "\nClosing line of all") for i in range(9)]
    data += [(1, 100, datetime(2024, 1, 3), "Closing line of all, and after it"), (None, 7, None, "no channel " + "x" * 40), (None, 8, None, "no channel " + "y" * 40)]
    return rows(data, POSTS)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_prompt_texts_are_shuffled_once_and_digests_alone_if_asked(rows):
    frame = channel_posts(rows)
    bodies = T.prompt_posts(frame)
    assert plan_of(bodies).count("Exchange hashpartitioning(own channel") == 1  # of the posts, for the window and the join together
    digests = T.prompt_posts(frame, F.md5)
    below = plan_of(digests).split("Exchange hashpartitioning(own channel")[1].split("Exchange")[0]
    assert "md5(" in below  # made before the exchange
    whole = {(r["channel_id"], r["slot"]): hashlib.md5(r["body"].encode()).hexdigest() for r in bodies.collect()}
    assert {(r["channel_id"], r["slot"]): r["body"] for r in digests.collect()} == whole and len(whole) == 12 and {s for c, s in whole if c is None} == {1, 2}


def test_footers_meet_texts_without_a_shuffle(rows):
    frame = channel_posts(rows)
    plan = plan_of(T.long_posts(frame).join(T.repeating_footers(frame), "channel_id"))
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_footers_go_to_the_texts_beyond_the_limit_of_the_planner(spark, rows, monkeypatch):
    frame = channel_posts(rows)
    expected = {(r["channel_id"], r["footer"], r["footer_posts"]) for r in T.repeating_footers(frame).collect()}
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        footers = T.repeating_footers(frame)
        for how in ("inner", "left"):
            assert "hashpartitioning" not in plan_of(T.long_posts(frame).join(footers, "channel_id", how))
        monkeypatch.setattr(T, "FOOTER_BYTES", 10)
        dealt = T.repeating_footers(frame)
        assert "hashpartitioning" in plan_of(T.long_posts(frame).join(dealt, "channel_id"))
    finally:
        spark.conf.set(key, before)
    assert expected and all({(r["channel_id"], r["footer"], r["footer_posts"]) for r in f.collect()} == expected for f in (footers, dealt))


def test_posts_are_searched_for_keywords_once(rows):
    texts = ["Python и DOCKER", "КУРС ВАЛЮТ, мем", "größe ünd straße", "", None, "api" + "ы" * 50 + "новости", "курс валют", "İ ai Новости"]
    words = [w for listed in TYPE_KEYWORDS.values() for w in listed]
    got = rows(list(enumerate(texts)), "i long, t string").select("i", keyword_mask(F.col("t")).alias("m")).collect()
    assert {r["i"]: r["m"] or 0 for r in got} == {i: sum(1 << k for k, w in enumerate(words) if w in (t or "").lower()) for i, t in enumerate(texts)}
    frame = channel_posts(rows)
    plan = plan_of(T.channel_types(frame, frame.select("channel_id", F.lit(None).cast("string").alias("category")).distinct()))
    assert "ontains(" not in plan and "Scan parquet" in plan


def test_only_premium_accounts_are_grouped(rows):
    comments = rows([(1, 1, 5, "a"), (1, 2, 6, "b"), (1, 3, 7, "c"), (1, 4, 8, "d"), (1, 5, 9, "")], "channel_id long, comment_id long, user_id long, text string")
    audience = rows([(1, 5, True), (1, 5, False), (1, 5, True), (1, 6, None), (1, 7, False), (2, 8, True)], "channel_id long, user_id long, is_premium boolean")
    noted = T.comments_with_premium(comments, audience)
    assert sorted((r["comment_id"], r["is_premium"]) for r in noted.collect()) == [(1, True), (2, False), (3, False), (4, False)]
    assert any("Filter" in line and "is_premium" in line for line in plan_of(noted).splitlines())
