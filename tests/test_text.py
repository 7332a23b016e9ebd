"""Text functions on wordings with known answers."""

import random
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trustlens.functions import text as X
from trustlens.operators import model_answers as J
from trustlens.operators import text_corpus as T


def each(rows, values, column):
    frame = rows([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in frame.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


def test_clean_text(rows):
    values = ["a https://x.y/z?q b", "see t.me/abc/12 now", "hi 😀😀😀 there", "two 😀😀 stay", "a\n\n\n\n\nb", "  \n padded \t", None, "🌀🌀🌀"]
    assert each(rows, values, X.clean_text) == ["a  b", "see  now", "hi  there", "two 😀😀 stay", "a\n\nb", "padded", "", "🌀🌀🌀"]
    assert each(rows, ["🌀🌀🌀x"], lambda c: X.clean_text(c, symbols=True)) == ["x"]


@pytest.mark.parametrize("text, status", [
    (None, 0), ("", 0), ("Новости дня", 0), ("Реклама: @manager", 2), ("РЕКЛАМУ НЕ ПРОДАЮ", 0), ("Без рекламы, связь @me_here", 0), ("по вопросам @admin_1", 1),
    ("Прайс в описании", 2), ("PR", 2), ("april", 0), ("ad free channel", 0), ("write  to us", 1), ("Взаимный пиар, ВП", 2), ("вп", 1), ("без вп", 0),
    ("t.me/owner", 1), ("партнёрство", 2), ("my blog", 0), ("promo", 2), ("promotion", 0),
])
def test_ad_status(rows, text, status):
    assert each(rows, [text], X.ad_status) == [status]


def contacts(rows, text, own="mychannel"):
    frame = rows([(text, own)], "d string, u string")
    return [tuple(c) for c in frame.select(X.ad_contacts(F.col("d"), F.col("u")).alias("c")).collect()[0]["c"] or []]


def test_contacts(rows):
    assert contacts(rows, "Реклама: @Manager_1") == [("manager_1", "@manager_1", "telegram", 80)]
    assert contacts(rows, "write @helper_bot") == [("helper_bot", "@helper_bot", "bot", 30)]
    assert contacts(rows, "me @MyChannel, other @other1 @OTHER1 t.me/other1 Telegram.me/third") == [
        ("other1", "@other1", "telegram", 30), ("third", "t.me/third", "telegram_link", 25)]
    assert contacts(rows, "@ab @abc") == [] and contacts(rows, None) == []
    far = "прайс" + " " * 60 + "@seller1" + " " * 46 + "прайс"
    assert contacts(rows, far) == [("seller1", "@seller1", "telegram", 30)]
    near = "прайс" + " " * 45 + "@seller1"
    assert contacts(rows, near)[0][3] == 80
    two = "реклама @first1" + " " * 70 + "@second2"
    assert [c[3] for c in contacts(rows, two)] == [80, 30]


def test_answer_category(rows):
    values = ["<category> news </category> CATEGORY: TECH", "category: finance", "NEWS or maybe TECH then", "xxcryptoxx", "nothing", "<category>ODD</category> beauty", "AI_ML"]
    assert each(rows, values, X.answer_category) == ["NEWS", "FINANCE", "TECH", "CRYPTO", None, "BEAUTY", "AI_ML"]


def test_tidy_summary(rows):
    long_tail = "x" * 250 + ". " + "y" * 200
    early = "x" * 100 + ". " + "y" * 400
    values = ['"**Bold** text\n\nwith   blanks ' + "z" * 40 + '"', "short", long_tail, early]
    got = each(rows, values, X.tidy_summary)
    assert got[0] == "Bold text with blanks " + "z" * 40 and got[1] is None
    assert got[2] == "x" * 250 + "." and got[3] == early[:400]


def test_flag_category(rows):
    assert each(rows, ["1win", "18+", "drugs", "FAKE news", "calm", None], J.flag_category) == ["GAMBLING", "ADULT", "SCAM", "SCAM", None, None]


def posts(rows, texts, channel=1):
    from datetime import datetime, timedelta

    data = [(channel, i, datetime(2024, 1, 1) - timedelta(hours=i), text) for i, text in enumerate(texts)]
    return rows(data, "channel_id long, post_id long, ts timestamp, text string")


def body(i):
    return f"this is the body number {i} with words enough to be a post of more than fifty characters"


def test_footer_needs_forty_percent(rows):
    texts = [body(i) + ("\n\n  Subscribe to us here  " if i < 4 else "") for i in range(10)]
    found = T.repeating_footers(posts(rows, texts)).collect()
    assert [(r["footer"], r["footer_posts"]) for r in found] == [("Subscribe to us here", 4)]
    texts[3] = body(3)
    assert T.repeating_footers(posts(rows, texts)).collect() == []


def test_footer_needs_five_posts_and_first_line_wins(rows):
    texts = [body(i) + "\nfirst closing line\nsecond closing line" for i in range(5)]
    assert T.repeating_footers(posts(rows, texts)).collect()[0]["footer"] == "first closing line"
    assert T.repeating_footers(posts(rows, texts[:4])).collect() == []


def test_without_footer(rows):
    frame = rows([("abc\nfoot\nmore", "foot"), ("foot first", "foot"), ("none", "foot"), ("keep", None)], "t string, f string")
    assert sorted(r["o"] for r in frame.select(T.without_footer(F.col("t"), F.col("f")).alias("o")).collect()) == ["abc", "foot first", "keep", "none"]


def test_prompt_posts_use_whole_texts(rows):
    texts = [body(i) + "pqrst"[i] * 3000 + "\nClosing line of all" for i in range(5)]
    got = T.prompt_posts(posts(rows, texts)).orderBy("slot").collect()
    assert [r["body"] for r in got] == [body(i) + "pqrst"[i] * 3000 for i in range(5)]


def test_channel_type(rows):
    from datetime import datetime, timedelta

    texts = ["python и docker", "github", "ends with курс", "валют растёт, новости, срочно"]
    data = [(1, i, datetime(2024, 1, 1) - timedelta(hours=i), t) for i, t in enumerate(texts)] + [(2, 1, datetime(2024, 1, 1), "btc eth nft")]
    frame = rows(data, "channel_id long, post_id long, ts timestamp, text string")
    channels = rows([(1, None), (2, "NEWS"), (3, None), (4, "GAMBLING")], "channel_id long, category string")
    got = {r["channel_id"]: (r["channel_type"], r["keyword_hits"]) for r in T.channel_types(frame, channels).collect()}
    assert got == {1: ("TECH", 3), 2: ("NEWS", 3), 3: ("GENERAL", 0), 4: ("GENERAL", 0)}
    empty = rows([(1, 100 + i, datetime(2024, 2, 1) + timedelta(hours=i), "") for i in range(20)], "channel_id long, post_id long, ts timestamp, text string")
    one = channels.where("channel_id = 1")
    assert T.channel_types(frame.unionByName(empty), one).collect()[0]["channel_type"] == "TECH"
    assert T.channel_types(frame.unionByName(empty), one, newest=20).collect()[0]["channel_type"] == "GENERAL"
    crossing = frame.where("channel_id = 1 AND post_id >= 2")
    assert T.channel_types(crossing, channels.where("channel_id = 1")).collect()[0]["channel_type"] == "NEWS"


def test_answers(rows):
    values = [
        '{"ad_percentage": 12, "toxicity": 3}', 'Sure! {"ad_percentage": 7, "nested": {"a": 1}} and {"more": 2}', "Ad_percentage: 55\nred_flags: [\"x\", \"y\"]",
        "", "   ", "no fields at all", '{"broken": ', '{"safety": {"status": "HIGH", "flags": ["Porn site"]}, "audience": {"trust_score": 20, "verdict": "BOT_FARM"}}',
    ]
    frame = rows([(i, v) for i, v in enumerate(values)], "key int, response string")
    answers = J.answer_fields(frame)
    flat = J.flat_fields(answers).orderBy("key").collect()
    assert [r["level"] for r in flat] == ["json", "json", "fields", "empty", "empty", "failed", "repaired", "json"]
    assert [r["ad_percentage"] for r in flat] == [12, 7, 55, 0, 0, 0, 0, 0]
    assert flat[2]["red_flags"] == ["x", "y"]
    last = J.flat_record(answers, rows([(7, 20)], "key int, posts long")).orderBy("key").collect()[-1]
    assert (last["is_toxic"], last["toxic_category"], last["bot_percentage"], last["authenticity_tier"], last["category"]) == (True, "ADULT", 80, "LOW", "LIFESTYLE")


def test_toxic_ratio_bound(rows):
    template = '{{"severity_label": "{s}", "toxic_category": {c}, "toxic_post_count": {n}, "total_posts": 50}}'
    cases = [("MEDIUM", '"SCAM"', 5, False), ("MEDIUM", '"SCAM"', 6, True), ("HIGH", '"SCAM"', 0, True), ("HIGH", "null", 9, False), ("HIGH", '"null"', 9, False), ("LOW", '"SCAM"', 50, False)]
    frame = rows([(i, 0, template.format(s=s, c=c, n=n)) for i, (s, c, n, _) in enumerate(cases)], "key int, turn int, response string")
    assert [r["is_toxic"] for r in J.toxicity(J.answer_fields(frame)).orderBy("key").collect()] == [c[3] for c in cases]


def test_footers_equal_a_plain_count(spark, rows):
    """Channels of several sizes, one with most of the posts and very many different lines; lines are counted as often as they stand."""
    rng = random.Random(8)
    data, by = [], defaultdict(list)
    for channel, n in enumerate([3000, 40, 5, 4, 12, 30, 7]):
        closing = [f"closing line {channel} {k}" for k in range(3)]
        for k in range(n):
            body = "\n".join(" ".join(rng.choice("abcdefgh") * rng.randrange(3, 9) for _ in range(rng.randrange(3, 12))) for _ in range(rng.randrange(1, 5)))
            ends = [c for j, c in enumerate(closing) if rng.random() < (0.45, 0.38, 0.5)[(j + channel) % 3]]
            text = "\n".join([body, *ends, *(["closing line 0 0  "] if k % 9 == 0 else [])])
            ts = None if k % 50 == 49 else datetime(2024, 1, 1 + k % 28, k % 7)
            data.append((channel, 10 * k + channel, ts, text))
            by[channel].append((ts is not None, ts or datetime(1970, 1, 1), 10 * k + channel, text))
    expected = {}
    for channel, listed in by.items():
        cleaned = [t.strip() for *_, t in sorted(listed, reverse=True) if len(t) > 30]
        endings = [t[-200:] for t in cleaned if len(t) > 50]
        counts = Counter(x.strip() for e in endings for x in e.split("\n") if len(x.strip()) > 10)
        often = [x for x, n in counts.items() if n >= len(cleaned) * 0.4]
        if len(cleaned) >= 5 and len(endings) >= 5 and often:
            expected[channel] = (often[0], counts[often[0]])
    found = T.repeating_footers(rows(data, "channel_id long, post_id long, ts timestamp, text string").repartition(7))
    assert {r["channel_id"]: (r["footer"], r["footer_posts"]) for r in found.collect()} == expected and len(expected) >= 4
