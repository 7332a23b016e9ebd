"""Audience statistics against brute force, including one channel that owns most accounts."""

import random

import pytest
from pyspark.sql import functions as F

from trustlens.operators import audience as A
from trustlens.sources import compact as K

SCHEMA = """channel_id long, user_id long, username string, is_premium boolean, is_scam boolean, is_fake boolean, is_restricted boolean,
is_deleted boolean, is_bot boolean, dc_id int"""


def account(channel, user, premium=False, scam=False, fake=False, dc=None, bot=False):
    return (channel, user, f"user{user}", premium, scam, fake, False, False, bot, dc)


def brute(ids):
    ids = sorted(ids)
    return sum(b - a <= 500 for a, b in zip(ids, ids[1:]))


@pytest.mark.parametrize("spread", [5, 400, 600, 20000])
def test_neighbour_pairs(rows, spread):
    rng = random.Random(spread)
    ids = {channel: [rng.randrange(1, spread * size) for _ in range(size)] for channel, size in {1: 3000, 2: 40, 3: 1, 4: 2}.items()}
    frame = rows([account(c, u) for c, users in ids.items() for u in users], SCHEMA).repartition(5)
    got = {r["channel_id"]: (r["ids"], r["neighbour_pairs"]) for r in A.neighbour_pairs(frame).collect()}
    assert got == {c: (len(users), brute(users)) for c, users in ids.items()}


def test_neighbour_gap_limit(rows):
    frame = rows([account(1, u) for u in (1000, 1500, 2001, 2501, 2501)], SCHEMA)
    assert A.neighbour_pairs(frame).collect()[0]["neighbour_pairs"] == 3


def forensic(rows, accounts):
    return A.forensics(rows(accounts, SCHEMA)).collect()[0]


def test_too_few_accounts(rows):
    r = forensic(rows, [account(1, 1000 + i, scam=True, dc=1) for i in range(9)])
    assert r["status"] == "insufficient_data" and r["total_penalty"] == 0 and not r["clustered"] and not r["flagged"]


def test_farm(rows):
    r = forensic(rows, [account(1, 1000 + 50 * i, dc=1) for i in range(30)])
    assert r["clustered"] and r["geo_mismatch"] and r["premium_penalty"] == -20
    assert r["total_penalty"] == -100 - 50 - 20 and r["neighbour_ratio"] == 1.0


@pytest.mark.parametrize("close, clustered, suspicious", [(3, False, False), (4, False, True), (6, False, True), (7, True, False)])
def test_cluster_thresholds(rows, close, clustered, suspicious):
    """Of 20 gaps, 3 are .15, 6 are .30: both bounds are exclusive."""
    users, last = [10_000], 10_000
    for i in range(20):
        last += 100 if i < close else 50_000
        users.append(last)
    r = forensic(rows, [account(1, u, premium=i == 0) for i, u in enumerate(users)])
    assert (r["clustered"], r["suspicious"]) == (clustered, suspicious)


@pytest.mark.parametrize("foreign, expected", [(15, False), (16, True)])
def test_geo_threshold(rows, foreign, expected):
    r = forensic(rows, [account(1, 100_000 * (i + 1), dc=3 if i < foreign else 2) for i in range(20)])
    assert r["geo_mismatch"] is expected


def test_geo_needs_five_known(rows):
    r = forensic(rows, [account(1, 100_000 * (i + 1), dc=1 if i < 4 else None) for i in range(20)])
    assert not r["geo_mismatch"] and r["foreign_ratio"] == 0.0 and r["with_dc"] == 4


def test_premium_and_flags(rows):
    r = forensic(rows, [account(1, 100_000 * (i + 1), premium=i < 2, fake=i == 5, bot=i == 6) for i in range(20)])
    assert r["premium_penalty"] == 10 and r["premium_ratio"] == 0.1
    assert r["flagged"] and r["flag_penalty"] == -10 and r["n_flagged"] == 2
    only_bots = forensic(rows, [account(1, 100_000 * (i + 1), premium=i == 0, bot=True) for i in range(20)])
    assert not only_bots["flagged"] and only_bots["n_bot"] == 20 and only_bots["premium_penalty"] == 0


def test_large_channel_is_paged_whole(rows):
    frame = rows([account(1, i + 1, premium=i % 7 == 0) for i in range(2500)] + [account(2, 5, premium=True)], SCHEMA)
    compact = K.compact_accounts(frame)
    sizes = compact.select("channel_id", F.size(F.from_json("user_ids", "i ARRAY<BIGINT>")["i"]).alias("n")).collect()
    assert max(r["n"] for r in sizes) < 200 and sum(r["n"] for r in sizes if r["channel_id"] == 1) == 2500
    restored = {(r["channel_id"], r["user_id"], r["is_premium"]) for r in K.restore_accounts(compact).collect()}
    assert restored == {(1, i + 1, i % 7 == 0) for i in range(2500)} | {(2, 5, True)}


def test_positions_beyond_the_list_are_ignored(rows):
    compact = rows([(1, '{"i": [11, 12], "p": [1, 9], "_v": 1}')], "channel_id long, user_ids string")
    assert {(r["user_id"], r["is_premium"]) for r in K.restore_accounts(compact).collect()} == {(11, False), (12, True)}


def test_first_flagged(rows):
    frame = rows([account(1, i, scam=i % 2 == 0, fake=i % 4 == 0) for i in range(1, 60)], SCHEMA)
    got = A.first_flagged(frame).orderBy("position").collect()
    assert [r["user_id"] for r in got] == [2 * i for i in range(1, 11)] and got[1]["flags"] == ["scam", "fake"]


def test_repeated_accounts_count_once(rows):
    """Twenty clean ids seen twice stay clean, and a doubled table changes nothing."""
    clean = [account(1, 100_000 * i, premium=i == 3, dc=2) for i in range(1, 21)] + [account(2, 7000 * i, bot=i % 2 == 0, dc=1) for i in range(1, 8)]
    frame = rows(clean, SCHEMA)
    once = {r["channel_id"]: r.asDict() for r in A.forensics(frame).collect()}
    twice = {r["channel_id"]: r.asDict() for r in A.forensics(frame.unionByName(frame)).collect()}
    assert once == twice and not twice[1]["clustered"] and twice[1]["neighbour_ratio"] == 0.0 and twice[2]["status"] == "insufficient_data"
    mixed = frame.where("channel_id = 1").unionByName(rows([account(1, 100_000, scam=True, dc=1)], SCHEMA))
    assert A.forensics(mixed).collect()[0]["n_scam"] == 1, "the least row of an account stays: data centre 1 before 2"
