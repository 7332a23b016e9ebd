"""Keyed merges, queues and link networks."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trustlens.operators import lifecycle as L
from trustlens.operators import network as N

NOW = datetime(2024, 1, 31)


def as_of():
    return F.lit(NOW).cast("timestamp")


def names(df):
    return sorted(r["username"] for r in df.collect())


def test_queue_positions_with_many_equal_times(rows):
    rng = random.Random(3)
    data = [(NOW if i % 3 else NOW - timedelta(minutes=rng.randrange(400)), i) for i in range(3000)]
    rng.shuffle(data)
    got = {r["id"]: r["position"] for r in L.queue_positions(rows(data, "at timestamp, id long").repartition(7), "at", "id").collect()}
    assert got == {key: place for place, (_, key) in enumerate(sorted(data), start=1)}


def test_latest_by_key(rows):
    data = [("a", 1, 10, None), ("a", 2, 20, "x"), ("b", 5, 1, "y"), ("a", 2, 19, "z")]
    got = L.latest_by_key(rows(data, "k string, t int, s int, v string"), ["k"], ["t", "s"]).orderBy("k").collect()
    assert [(r["k"], r["s"], r["v"]) for r in got] == [("a", 20, "x"), ("b", 1, "y")]


def test_new_names_ignores_known_and_case(rows):
    known = rows([("one",)], "username string")
    found = rows([("@One", "a"), ("@@Two", "b"), ("two", "a")], "username string, found_via string")
    assert [tuple(r) for r in L.new_names(known, found).collect()] == [("two", "a")]


def test_skip_list_bounds(rows):
    skip = rows([("now", NOW), ("later", NOW + timedelta(seconds=1)), ("gone", NOW - timedelta(days=1))], "username string, expires_at timestamp")
    candidates = rows([("now",), ("later",), ("gone",), ("free",)], "username string")
    assert names(L.not_skipped(candidates, skip, as_of())) == ["free", "gone", "now"]
    kept = L.skipped_until(skip, rows([("gone",)], "username string"), as_of(), 7)
    assert {r["username"]: r["expires_at"] for r in kept.collect()} == {"later": NOW + timedelta(seconds=1), "gone": NOW + timedelta(days=7)}


def test_complete_waiting_is_conditional(rows):
    results = rows([("a", "WAITING", 1, "NEWS"), ("b", "GOOD", 2, "TECH"), ("c", "WAITING", 3, None)], "username string, status string, score int, category string")
    fresh = rows([("a", "GOOD", 80, None), ("b", "BAD", 10, "NEWS")], "username string, status string, score int, category string")
    got = {r["username"]: (r["status"], r["score"], r["category"], r["written"]) for r in L.complete_waiting(results, fresh, ["status", "score"], ["category"]).collect()}
    assert got == {"a": ("GOOD", 80, "NEWS", True), "b": ("GOOD", 2, "TECH", False), "c": ("WAITING", 3, None, False)}


def test_patch_rows(rows):
    results = rows([("a", 1, "NEWS", NOW - timedelta(days=9)), ("b", 2, "TECH", NOW - timedelta(days=9))], "username string, score int, category string, scanned_at timestamp")
    patch = rows([("a", 7, None, "{}")], "username string, score int, category string, safety string")
    got = {r["username"]: r for r in L.patch_rows(results, patch, as_of()).collect()}
    assert (got["a"]["score"], got["a"]["category"], got["a"]["safety_json"], got["a"]["scanned_at"]) == (7, "NEWS", "{}", NOW)
    assert (got["b"]["score"], got["b"]["safety_json"], got["b"]["patched"]) == (2, None, False)


def test_cache_expiry(rows):
    cache = rows([("k", NOW - timedelta(days=7), 1), ("j", NOW - timedelta(days=6), 2), ("j", NOW - timedelta(days=5), 3)], "key string, cached_at timestamp, turn int")
    got = {r["key"]: (r["hit"], r["turn"]) for r in L.cached_answers(rows([("k",), ("j",), ("x",)], "key string"), cache, as_of()).collect()}
    assert got == {"k": (False, None), "j": (True, 3), "x": (False, None)}


def test_triage(rows):
    results = rows([("scored1", "GOOD", 70), ("zero1", "BAD", 0), ("waiting1", "WAITING", None)], "username string, status string, score int")
    queue = rows([("waiting1", 4)], "username string, position long")
    asked = rows([("@Scored1",), ("zero1",), ("waiting1",), ("fresh1",), ("no",), ("1bad",)], "username string")
    got = {r["username"]: (r["answer"], r["queue_position"]) for r in L.triage(asked, results, queue).collect()}
    assert got == {"scored1": ("scored", None), "zero1": ("new", None), "waiting1": ("queued", 4), "fresh1": ("new", None), "no": ("invalid", None), "1bad": ("invalid", None)}


def test_remove_only_waiting(rows):
    results = rows([("a", "WAITING"), ("b", "GOOD"), ("c", "WAITING")], "username string, status string")
    gone = rows([("a",), ("b",)], "username string")
    assert names(L.remove_keys(results, gone, ["username"], only_waiting=True)) == ["b", "c"]
    assert names(L.remove_keys(results, gone, ["username"])) == ["c"]


def test_neighbour_risk(rows):
    data = [(1, "a", "GOOD", "GOOD", ["b", "c", "d", "b", "a", "x"]), (2, "b", "BAD", "SCAM", []), (3, "c", "BAD", "MEDIUM", ["b"]), (4, "d", "WAITING", "SCAM", None)]
    got = {r["channel_id"]: (r["scam_count"], r["bad_count"]) for r in N.neighbour_risk(rows(data, "channel_id long, username string, status string, verdict string, ad_links array<string>")).collect()}
    assert got == {1: (1, 1), 2: (0, 0), 3: (1, 0), 4: (0, 0)}


def test_reachable_stops_and_keeps_first_hop(rows):
    edges = rows([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    start = rows([("a",)], "username string")
    assert {r["username"]: r["hop"] for r in N.reachable(edges, start, 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {r["username"]: r["hop"] for r in N.reachable(edges, start).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}


def test_outgoing_links(rows):
    schema = "channel_id long, post_id long, ts timestamp, text string, forward_from struct<id: bigint, type: string, username: string>"
    posts = rows([
        (1, 1, NOW, "T.me/OtherChan and @self_chan and @somebot t.me/linkbot", None), (1, 2, NOW, "telegram.me/third_one @python @abcd", (9, "channel", "fwd")),
        (1, 3, NOW, None, (9, "channel", "joinchat")), (1, 4, NOW, None, (1, "channel", "self_chan")),
    ], schema)
    channels = rows([(1, "Self_Chan")], "channel_id long, username string")
    assert sorted(r["link"] for r in N.outgoing_links(posts, channels).collect()) == ["fwd", "joinchat", "linkbot", "otherchan", "third_one"]


def test_repeated_names_write_once(rows):
    results = rows([("a", "WAITING", 1, None), ("b", "GOOD", 2, "NEWS")], "username string, status string, score int, category string")
    new = rows([("a", "GOOD", 5, "TECH"), ("a", "GOOD", 9, "TECH")], "username string, status string, score int, category string")
    got = L.complete_waiting(results, new, ["status", "score"], ["category"]).orderBy("username").collect()
    assert [(r["username"], r["score"]) for r in got] == [("a", 9), ("b", 2)]


def test_lines_that_do_not_fit_are_kept_apart(spark, tmp_path):
    from trustlens.sources import raw_messages as W

    lines = ['{"channel_id": 1, "id": 2, "date": 3, "message": "x", "views": 4}', '{"channel_id": 1, "id": 3, "views": "many"}', "no json", "", '{"channel_id": 1, "id": 4}']
    (tmp_path / "m.json").write_text("\n".join(lines))
    path = str(tmp_path / "m.json")
    assert W.read_messages(spark, path).select("id").orderBy("id").collect() == W.read_messages(spark, path).orderBy("id").select("id").collect()
    assert [r["id"] for r in W.read_messages(spark, path).orderBy("id").collect()] == [2, 4]
    assert {r["line"] for r in W.rejected_messages(spark, path).collect()} == {lines[1], lines[2]}
