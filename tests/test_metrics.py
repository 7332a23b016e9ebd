"""Channel metrics against plain Python on made-up posts."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trustlens.operators import channel_metrics as M

START = datetime(2024, 1, 30)
SCHEMA = """channel_id long, post_id long, ts timestamp, views long, forwards long, replies long,
reactions array<struct<emoji: string, count: bigint>>, forward_from struct<id: bigint, type: string, username: string>, text string"""


def post(channel, number, hours, views, forwards=0, replies=0, reactions=None, source=None, text=None):
    forward = (source, "channel", None) if source else None
    return (channel, number, START - timedelta(hours=hours), views, forwards, replies, reactions, forward, text)


def random_posts(seed, channel, count):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        views = rng.choice([0, rng.randrange(1, 4000)])
        reactions = rng.choice([None, [], [("👍", rng.randrange(200)), ("❤", rng.randrange(60)), ("🎉", rng.randrange(30))]])
        out.append(post(channel, i, rng.randrange(0, 900), views, rng.randrange(50), rng.randrange(9), reactions, rng.choice([None, 5, 6]),
                        rng.choice([None, "see T.me/+abc", "join t.me/joinchat/xy", "t.me/public_one", "nothing"])))
    return out


def expected(posts):
    """The metrics of one channel, written as loops over a list."""
    sample = sorted(posts, key=lambda p: (p[2], p[1]), reverse=True)
    total = [sum(c for _, c in p[6]) if p[6] else 0 for p in sample]
    views = [p[3] for p in sample if p[3]]
    viewed = [(p, r) for p, r in zip(sample, total) if p[3]]
    quarter = len(viewed) // 4
    out = {
        "posts": len(sample), "viewed_posts": len(views), "total_views": sum(p[3] for p in sample), "total_reactions": sum(total),
        "cv_views": statistics.stdev(views) / statistics.mean(views) * 100 if len(views) > 1 else 0.0,
        "forward_rate": sum(p[4] for p in sample) / sum(p[3] for p in sample) * 100,
        "avg_comments": sum(p[5] for p in sample) / len(sample),
        "reactions_on": any(p[6] is not None for p in sample),
        "repost_ratio": sum(p[7] is not None for p in sample) / len(sample),
    }
    sources = [p[7][0] for p in sample if p[7]]
    out["source_share"] = max(sources.count(s) for s in set(sources)) / len(sources) if sources else 0.0
    if len(sample) >= 12 and quarter >= 3:
        new, old = [p[3] for p, _ in viewed[:quarter]], [p[3] for p, _ in viewed[-quarter:]]
        out["decay"] = statistics.mean(old) / statistics.mean(new)
    else:
        out["decay"] = 1.0
    if len(viewed) >= 12:
        rates = [r / p[3] * 100 for p, r in viewed]
        out["er_new"], out["er_old"] = statistics.mean(rates[:max(quarter, 3)]), statistics.mean(rates[-max(quarter, 3):])
    positive = sorted(c for c in total if c > 0)
    if len(positive) >= 3:
        kept = positive[:-1] if len(positive) > 3 else positive
        out["stability_cv"] = round(statistics.stdev(kept) / statistics.mean(kept) * 100, 1) if statistics.mean(kept) else 0.0
    gaps = [(a[2] - b[2]).total_seconds() for a, b in zip(sample, sample[1:]) if a[2] > b[2]]
    out["interval_cv"] = statistics.pstdev(gaps) / statistics.mean(gaps) if len(gaps) > 1 else 0.0
    out["private_posts"] = sum("t.me/+" in (p[8] or "").lower() or "joinchat/" in (p[8] or "") for p in sample)
    out["public_posts"] = sum("joinchat" in (p[8] or "") or "public" in (p[8] or "") for p in sample)
    return out


@pytest.mark.parametrize("seed, count", [(1, 5), (2, 13), (3, 49), (4, 50), (5, 240)])
def test_against_loops(rows, seed, count):
    posts = random_posts(seed, 7, count)
    got = M.channel_metrics(rows(posts, SCHEMA)).collect()[0].asDict()
    for name, value in expected(posts).items():
        assert got[name] == pytest.approx(value, rel=1e-9, abs=1e-9), name


def test_one_channel_with_a_third_of_all_posts(rows):
    """Only its newest posts leave the map side, and the result is that of the newest posts alone."""
    hot = random_posts(8, 1, 4000)
    others = [p for c in range(2, 82) for p in random_posts(100 + c, c, 100)]
    frame = rows(hot + others, SCHEMA).repartition(8)
    got = {r["channel_id"]: r.asDict() for r in M.channel_metrics(frame).collect()}
    assert len(got) == 81
    for name, value in expected(hot).items():
        assert got[1][name] == pytest.approx(value, rel=1e-9, abs=1e-9), name


def test_scenarios(rows):
    """Healthy, bot wall and reaction-free channels."""
    healthy = [post(1, i, 4 * i, 1000 + 1200 * i // 50 + (17 * i % 400) - 200, 10, 5, [("👍", 20), ("❤", 10)]) for i in range(50)]
    wall = [post(2, i, 3 * i, [1000, 1010, 1020][i % 3], 1, 0, [("👍", 100)]) for i in range(30)]
    quiet = [post(3, i, 6 * i, 500 + i) for i in range(20)]
    got = {r["channel_id"]: r for r in M.channel_metrics(rows(healthy + wall + quiet, SCHEMA)).collect()}
    assert got[1]["reactions_on"] and got[1]["cv_views"] > 5 and got[1]["er_status"] != "insufficient_data"
    assert got[2]["cv_views"] < 10 and got[2]["emoji_types"] == 1 and got[2]["simple_share"] == 1.0
    assert got[2]["stability_cv"] == 0.0 and got[2]["flatness_on"]
    assert not got[3]["reactions_on"] and got[3]["stability_cv"] == 50.0 and got[3]["er_status"] == "always_dead"


def test_null_and_empty_reactions(rows):
    off = [post(1, i, i, 100, reactions=None) for i in range(3)]
    none_yet = [post(2, i, i, 100, reactions=[]) for i in range(3)]
    got = {r["channel_id"]: r["reactions_on"] for r in M.channel_metrics(rows(off + none_yet, SCHEMA)).collect()}
    assert got == {1: False, 2: True}


def test_impossible_counts(rows):
    data = [post(1, 1, 1, 10, forwards=11), post(2, 1, 1, 0, forwards=5), post(3, 1, 1, 10, reactions=[("👍", 11)])]
    got = {r["channel_id"]: r["impossible"] for r in M.channel_metrics(rows(data, SCHEMA)).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_posting_tiers(rows):
    cases = [(5.9, "TECH", "normal"), (6.0, "TECH", "active"), (12.0, "TECH", "heavy"), (20.0, "TECH", "spam"), (19.9, "NEWS", "normal"),
             (4.0, "BEAUTY", "active"), (10.0, "AI_ML", "active"), (6.0, None, "active"), (6.0, "", "active")]
    from pyspark.sql import functions as F

    frame = rows([(i, p, c) for i, (p, c, _) in enumerate(cases)], "i int, p double, c string")
    got = frame.select("i", M.posting_status(F.col("p"), F.col("c"), F.lit(5)).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [c[2] for c in cases]


def test_private_links_combinations(rows):
    from pyspark.sql import functions as F

    cases = [(1, 0, "TECH", True, 0.25), (9, 1, "TECH", True, 0.35), (7, 3, "TECH", True, 0.5), (5, 5, "TECH", True, 1.0),
             (5, 5, "CRYPTO", True, 0.45), (6, 5, "TECH", False, 0.4), (7, 3, "CRYPTO", False, 0.4), (0, 0, "CRYPTO", False, 1.0)]
    frame = rows([(i, *c[:4]) for i, c in enumerate(cases)], "i int, private_posts long, public_posts long, c string, on boolean")
    got = M.private_links(frame, F.col("c"), F.col("on")).orderBy("i").collect()
    assert [r["private_multiplier"] for r in got] == [c[4] for c in cases]


def test_hot_channel_is_spread_over_its_days(rows):
    """One channel with a third of all posts: positions are exact, and no group of the post windows holds more than a day of it."""
    posts = [p for channel in range(1, 11) for p in random_posts(channel, channel, 40)] + random_posts(99, 99, 200)
    frame = rows(posts, SCHEMA)
    got = {(r["channel_id"], r["post_id"]): r["rn"] for r in M.numbered_posts(frame).select("channel_id", "post_id", "rn").collect()}
    for channel in {p[0] for p in posts}:
        order = sorted((p for p in posts if p[0] == channel), key=lambda p: (p[2], p[1]), reverse=True)
        assert [got[channel, p[1]] for p in order] == list(range(1, len(order) + 1))
    days = frame.where("channel_id = 99").selectExpr("to_date(ts)").distinct().count()
    plan = M.numbered_posts(frame)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line and "post_id" in line]
    assert days > 5 and windows and all("own bucket" in line for line in windows)


def test_values_of_the_row_before(rows):
    from datetime import datetime

    data = [(1, 1, datetime(2024, 1, 1, 5), "a"), (1, 2, datetime(2024, 1, 1, 7), "b"), (1, 3, datetime(2024, 1, 3), "c"), (1, 4, None, "d"), (2, 5, None, "e")]
    frame = rows(data, "channel_id long, post_id long, ts timestamp, v string")
    newest = M.placed(frame, {"n": F.lit(True)}, {"before": F.col("v")})
    assert {r["v"]: (r["n"], r["before"]) for r in newest.collect()} == {"c": (1, None), "b": (2, "c"), "a": (3, "b"), "d": (4, "a"), "e": (1, None)}
    oldest = M.placed(frame, {"n": F.col("v") != "b"}, {"before": F.col("v")}, ascending=True)
    assert {r["v"]: (r["n"], r["before"]) for r in oldest.collect()} == {"a": (1, None), "b": (1, "a"), "c": (2, "b"), "d": (3, "c"), "e": (1, None)}
