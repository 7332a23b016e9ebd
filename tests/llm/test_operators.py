"""The operators against plain versions of their rules, on small tables with every odd case."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustlens.llm import decontamination, jaccard_join, language_id, license_scan, quality_classifier, quality_rules, repeated_bytes, source_mixing, substring_dedup, training_order

SCHEMA = """doc_id long, text string, lang string, source string, n_chars long, n_words int, copy int, start string, point string, node int, gram int,
packed string, text_key int, s string, quality string, rn int"""
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def odd_documents():
    """Nulls, empty, blank and very long texts, exact and near copies, shared passages, repeated ids and rows."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = prose(300), prose(80)
    near = [base.split() for _ in range(12)]
    for k, text in enumerate(near):
        text[20 * k] = "changed"
    texts = [
        None, "", " \t\n\x0b\x0c\r ", "one", "Two words", "a b c d", "A B C D", "a b c d e", base, base, base + " end", *map(" ".join, near), passage, prose(40) + " " + passage + " " + prose(30),
        prose(10) + "\n" + passage.upper(), passage + " " + passage, prose(8000), "x" * 5000, "the the the " * 40, prose(60) + "\n" + prose(5) + "\n" + prose(5), "éß" * 150, "éß" * 150 + "é",
    ]
    ids = [*range(len(texts) - 2), None, None]
    rows = list(zip(ids, texts, strict=True)) + [(3, "one"), (8, base), (9, prose(20)), (None, None), (None, base)]
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", None]), None, *[7, 7, "x", "p", 1, 2, "q", 3, "s", "q", 4]) for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    data = odd_documents()
    spark.createDataFrame(data, SCHEMA).repartition(5).createOrReplaceTempView("odd_documents")
    return [(r[0], r[1]) for r in data], spark.table("odd_documents")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(frame):
    return Counter(tuple(r) for r in frame.collect())


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_base_counts(odd, empty):
    expected = Counter()
    for i, text in odd[0]:
        words = BLANK.findall(text or "")
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {j + k for j in range(len(words) - 2) if windows[tuple(words[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if BLANK.search(x)]
        symbols = sum(c in "#*$%&|<>" for c in text or "")
        expected[i, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)] += 1
    report = quality_rules.quality_report(odd[1])
    assert rows_of(report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == expected
    assert report.where("base_failed and kept").count() == 0 and quality_rules.quality_report(empty).count() == 0
    kept = quality_rules.keep_good(odd[1])
    assert kept.columns == odd[1].columns and kept.count() == report.where("kept").count()


def test_distance_from_references(spark):
    """A text of another kind lies far from both references, and the distance is that of Jensen and Shannon."""
    plain = "the cat and the dog are in the house of the man that was by the sea with all of it " * 12
    rng = random.Random(1)
    data = [(k, " ".join(sorted(plain.split(), key=lambda _: rng.random())), "en") for k in range(6)] + [(7, "%%%### ***$$$ &&&||| <><> " * 30 + "#".join("abcdefghij" * 9), "en")]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string")
    digested = quality_rules.digests(frame).drop("text")
    refs = quality_rules.references(digested)
    share = refs.collect()[0]["refs"][0]
    own = {r["doc_id"]: r["quality digest"] for r in digested.collect()}
    for r in quality_rules.judged(digested, refs).collect():
        p, q = np.array(own[r["doc_id"]]["classes"]), np.array(share["c"])
        p, m = p / p.sum(), (p / p.sum() + q) / 2
        part = lambda a: np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum()
        assert r["quality"]["char_distance"] == pytest.approx(np.sqrt((part(p) + part(q)) / 2), abs=1e-9)
        assert r["quality"]["kept"] == (r["doc_id"] != 7 and not r["quality"]["base_failed"])


def test_references_by_language(spark):
    """70 languages are all kept, a stray label changes no other verdict, and the word distance is that of a plain version."""
    rng = random.Random(6)
    plain = list("the of and to in is it that was for".split())
    data = []
    for lang in range(70):
        letters = [chr(0x61 + k) for k in range(26)] if lang < 60 else [chr(0x400 + 40 * (lang - 60) + k) for k in range(30)]
        own = ["".join(rng.choice(letters) for _ in range(5)) for _ in range(300)] + plain * (20 if lang == 0 else 0)
        data += [(10 * lang + k, " ".join(rng.choice(own) for _ in range(300)), f"l{lang:02}") for k in range(6 + (lang < 5))]
    schema = "doc_id long, text string, lang string"

    def measured(rows):
        return {r["doc_id"]: r for r in quality_rules.quality_report(spark.createDataFrame(rows, schema).repartition(4)).collect()}

    got = measured(data)
    assert all(r["kept"] for r in got.values()) and len(got) == len(data)
    junk = (9001, "%%% ### *** " * 100 + " ".join(f"q{k}" for k in range(900)), "stray")
    other = measured([*data, junk])
    assert {k: tuple(r) for k, r in other.items() if k != 9001} == {k: tuple(r) for k, r in got.items()} and other[9001]["word_distance"] is None
    assert not other[9001]["kept"]
    # a text of one language under the label of another is far from the reference of its label
    assert not measured([*data, (9002, data[-1][1], "l00")])[9002]["kept"]
    listed = {w: k for k, w in enumerate(quality_rules.VOCABULARY)}
    shares = {}
    for i, text, lang in data:
        counts = Counter(listed.get(w, -1) for w in text.split())
        shares[i] = lang, counts, len(text.split())
    for i, (lang, counts, n) in shares.items():
        whole, size = Counter(), 0
        for other_lang, c, m in shares.values():
            if other_lang == lang:
                whole, size = whole + c, size + m
        spread = 0.0
        for w in {*counts, *whole}:
            p, q = counts[w] / n, whole[w] / size
            spread += sum(x * np.log2(2 * x / (p + q)) for x in (p, q) if x > 0) / 2
        assert got[i]["word_distance"] == pytest.approx(np.sqrt(max(spread, 0)), abs=1e-6)


def classes_of(rows, same):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if same(i, j):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("settings", [{}, {"block": 3, "block_tokens": 700}, {"block_pairs": 2}])
def test_jaccard_classes(spark, odd, empty, settings, monkeypatch):
    if settings:
        monkeypatch.setattr(jaccard_join, "MOST_IDS", 2)
        monkeypatch.setattr(jaccard_join, "CARRY", 4)
        monkeypatch.setattr(jaccard_join, "HOMES", 1)
        monkeypatch.setattr(jaccard_join, "NODE_TOKENS", 2000)
        monkeypatch.setattr(jaccard_join, "PAIRS_AT_ONCE", 2)
    rows = odd[0]
    sets = []
    for _, text in rows:
        words = BLANK.findall(lower(text))
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    link = lambda i, j: rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    root = classes_of(rows, link)
    least = defaultdict(lambda: 10**9)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(least[root[k]], i)
    expected = Counter((i, len(sets[k]), None if i is None else least[root[k]]) for k, (i, _) in enumerate(rows))
    assert rows_of(jaccard_join.similarity_classes(odd[1], **settings).select("doc_id", "n_shingles", "component_id")) == expected
    if not settings:
        kept = jaccard_join.one_of_each_group(odd[1])
        stays = {(i, t) for k, (i, t) in enumerate(rows) if i is not None and least[root[k]] == i}
        assert Counter((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None) == Counter(stays) and kept.columns == odd[1].columns
        assert jaccard_join.similarity_classes(empty).count() == 0


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 900, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 60 + 20 * (k % 9)], rng.integers(0, 2**63, 5 * (k % 7), dtype=np.uint64)])) for k in range(80)] + [rng.integers(0, 2**63, 50 + k, dtype=np.uint64) for k in range(60)]
    sizes, labels = np.array([len(s) for s in sets]), np.arange(len(sets))
    found = {tuple(sorted(p)) for p in jaccard_join.tree_pairs([jaccard_join.vector(s) for s in sets], sizes, labels, (3, 4))}
    linked = {(i, j) for j in range(len(sets)) for i in range(j) if 7 * len(np.intersect1d(sets[i], sets[j])) >= 3 * (sizes[i] + sizes[j])}
    assert linked <= found and len(linked) > 100 and not any(i >= 80 or j >= 80 for i, j in found if (i, j) not in linked and abs(i - j) > 70)


@pytest.mark.parametrize("hot, batch", [(1 << 16, 10_000), (2, 7)])
def test_repeated_bytes(spark, odd, empty, hot, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    rows = [(i, (t or "").encode()) for i, t in odd[0]]
    seen = Counter(t[p : p + 200] for _, t in rows for p in range(len(t) - 199))
    expected = Counter()
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = True
        spans = len(re.findall(rb"1+", gone.astype(np.uint8).tobytes().replace(b"\x01", b"1")))
        expected[i, len(t), int(gone.sum()), spans, sha(np.frombuffer(t, np.uint8)[~gone].tobytes())] += 1
    assert rows_of(repeated_bytes.remove_repeated_bytes(odd[1], hot=hot, with_text=False)) == expected
    assert repeated_bytes.remove_repeated_bytes(empty).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


@pytest.mark.parametrize("batch", [10_000, 5])
def test_substring_dedup(spark, odd, empty, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    rows = [(i, BLANK.findall(t or "")) for i, t in odd[0]]
    first = {}
    for i, words in rows:
        for k in range(len(words) - 49):
            if i is not None:
                first[tuple(words[k : k + 50])] = min(i, first.get(tuple(words[k : k + 50]), i))
    expected = Counter()
    for i, words in rows:
        gone = {k + j for k in range(len(words) - 49) if i is not None and first[tuple(words[k : k + 50])] < i for j in range(50)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        expected[i, len(words), len(gone), sha(kept), kept] += 1
    assert rows_of(substring_dedup.remove_repeats(odd[1])) == expected and substring_dedup.remove_repeats(empty).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


@pytest.mark.parametrize("block_bytes", [4 << 20, 200])
def test_decontamination(spark, odd, empty, block_bytes):
    rows = [(i, ALNUM.findall(lower(t))) for i, t in odd[0]]
    long = [w for _, w in rows if len(w) > 100]
    items = [(1, " ".join(long[0][5:40])), (2, "A, B; c d"), (3, None), (4, "!!"), (None, " ".join(long[-1][:30])), (10, " ".join(long[0][60:73])), (10, " ".join(long[3][10:50])), (5, " ".join(long[0][100:112]))]
    windows = defaultdict(set)
    for i, text in items:
        words = ALNUM.findall(lower(text))
        if i is not None and words:
            for k in range(max(1, len(words) - 12)):
                windows[tuple(words[k : k + 13])].add(str(i))
    expected, clean = Counter(), Counter()
    for (i, words), (_, text) in zip(rows, odd[0], strict=True):
        hit, names = set(), set()
        for m in {len(w) for w in windows}:
            for k in range(len(words) - m + 1):
                if tuple(words[k : k + m]) in windows:
                    names |= windows[tuple(words[k : k + m])]
                    hit |= set(range(k, k + m))
        bad = len(hit) > 0 and 20 * len(hit) >= len(words)
        expected[i, len(words), len(hit), len(names), sha(",".join(sorted(names))), bad] += 1
        clean[i, text] += not bad
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert sum(n for r, n in expected.items() if r[-1]) > 5
    assert rows_of(decontamination.contamination(odd[1], benchmark, block_bytes=block_bytes)) == expected
    kept = decontamination.decontaminate(odd[1], benchmark, block_bytes=block_bytes)
    assert rows_of(kept.select("doc_id", "text")) == +clean and kept.columns == odd[1].columns
    assert decontamination.contamination(empty, benchmark).count() == 0
    assert decontamination.contamination(odd[1], benchmark.limit(0)).where("contaminated or n_hit > 0").count() == 0


def test_runs_of_equal_words(spark):
    """A text and an item of 20,000 equal words, many items with one passage, one item twice."""
    import time

    passage = " ".join(f"w{k}" for k in range(40))
    items = [("run", "spam " * 20_000), *((f"p{k}", f"own{k} {passage}") for k in range(3_000)), ("p1", passage), ("end", "spam " * 13 + "ham")]
    texts = ["spam " * 20_000, "spam " * 12, f"{passage} " * 50, "x " + "spam " * 30 + "ham " + "spam " * 13]
    began = time.time()
    got = {r["doc_id"]: r for r in decontamination.contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert time.time() - began < 30
    assert [(got[k]["n_hit"], got[k]["n_items"], got[k]["contaminated"]) for k in range(4)] == [(20_000, 2, True), (0, 0, False), (2_000, 3_000, True), (44, 2, True)]
    assert got[2]["items_sha256"] == sha(",".join(sorted(f"p{k}" for k in range(3_000))))


def test_many_equal_rows(spark):
    """10,000 equal rows behind an earlier document that holds their passage."""
    passage = " ".join(f"w{k}" for k in range(400))
    frame = spark.createDataFrame([(1, passage)] + [(2, f"a {passage} b")] * 10_000, "doc_id long, text string").repartition(8)
    got = rows_of(substring_dedup.remove_repeats(frame, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256"))
    assert got == {(1, 400, 0, sha(passage)): 1, (2, 402, 400, sha("a b")): 10_000}


def test_suffix_automaton_and_parse():
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcd") for _ in range(300))
    model = language_id.models({"x": text})
    for size in (0, 1, 5, 200, 255):
        other = bytes(rng.choice(b"abcde") for _ in range(size))
        pieces, at = 0, 0
        while at < size:  # the longest match, or one unknown byte
            end = at + 1
            while end < size and other[at : end + 1] in text:
                end += 1
            pieces, at = pieces + 1, end
        got = language_id.pieces_per_row(np.frombuffer(other, np.uint8), np.array([0, size]), model["kinds"], model["tables"])
        assert got[0, 0] == pieces


def test_language_of_odd_texts(odd, empty):
    got = language_id.identify(odd[1]).collect()
    letters = {(i, t) for i, t in odd[0] if t and re.search(r"[^\W\d_]", t)}
    assert len(got) == len(odd[0]) and all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "fr", "und") for r in got)
    assert sum(r["lang_pred"] != "und" for r in got) == sum((i, t) in letters for i, t in odd[0])
    assert language_id.identify(empty).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd[1].withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_every_language_is_fitted(spark):
    """More languages than a block, the same long opening in all texts, one key on very many rows."""
    rng = random.Random(3)
    opening = "the same opening of all texts " * 120
    data = []
    for lang in range(70):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(30)]
        data += [(10 * lang + k, opening + " ".join(rng.choice(words) for _ in range(700)), f"l{lang:02}") for k in range(3)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(8)
    found = language_id.identify(frame, F.col("doc_id") % 10 < 2, F.col("doc_id") % 10 == 2, 2000).where("held_out").collect()
    assert len(found) == 70 and all(r["lang_pred"] == f"l{r['doc_id'] // 10:02}" for r in found)
    hot = spark.createDataFrame([(1, "Abc abc", "a")] * 500 + [(1, "other", "a"), (2, "Xyz", "b")], "doc_id long, text string, lang string")
    sampled = language_id.samples(hot, F.lit(True), 2000, 64)
    assert sorted(sampled["a"].split(b"\n")) == [b"", b"abc abc", b"other"] and sampled["b"] == b"xyz\n"


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    found = language_id.op4_language_id(spark, folder).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found)
    scored = quality_classifier.op7_quality_classifier(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in scored) >= 0.9 * len(scored) and all(0 <= r["score"] <= 1 for r in scored)


def test_quality_scores_of_odd_texts(spark, odd, empty):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(12)] + [(None, 1, 0), (3, None, 0), (900, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_classifier.score_quality(odd[1], labels, epochs=1).collect()
    assert len(got) == len(odd[0]) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert quality_classifier.score_quality(empty, labels, epochs=1).count() == 0
    assert {r["score"] for r in quality_classifier.score_quality(odd[1], labels.limit(0)).collect()} == {0.5}


def test_sample_of_repeated_rows(spark):
    """A labelled document that is repeated thousands of times, with equal and with other texts, is learned once and displaces no class."""
    rows = [(k, f"text {k}") for k in range(40)] + [(1, "text 1")] * 7_000 + [(3, f"other {k}") for k in range(3_000)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(1, 1)] * 500, "doc_id long, quality int")
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    texts, marks, weights, prior = quality_classifier.training_sample(documents, labels, F.lit(True), 15, 8)
    assert marks.tolist().count(0) == marks.tolist().count(1) == 15 and len({t[0] for t in texts}) == 30 and prior == 0.5 and set(weights) == {20 / 15}
    again = quality_classifier.training_sample(documents.repartition(7), labels, F.lit(True), 15, 8)
    assert again[0] == texts and again[1].tolist() == marks.tolist()


def test_network_covers_the_whole_text():
    """A piece of text moves the chunk maxima wherever it stands, also in the last bytes."""
    rng = np.random.default_rng(1)
    net = {"embed": rng.normal(0, 1, (257, 8)).astype(np.float32), "kernel": rng.normal(0, 1, (32, 48)).astype(np.float32), "shift": np.zeros(24, np.float32), "weight": np.ones(48, np.float32), "bias": np.zeros(1, np.float32)}
    for size in (0, 1, 4, 511, 512, 513, 2000):
        blocks, first = quality_classifier.blocks_of(np.full(size, 65, np.uint8), np.array([0, size]))
        begin, end, head = quality_classifier.chunk_bounds(first)
        covered = np.zeros(len(blocks) - 1, bool)
        for a, b in zip(begin, end, strict=True):
            covered[a:b] = True
        assert covered.all() and head[-1] == len(begin) and np.isfinite(quality_classifier.probabilities(np.full(size, 65, np.uint8), np.array([0, size]), net)).all()


def test_mixing(odd, empty, spark):
    import duckdb

    con = duckdb.connect()
    con.register("documents", odd[1].select("doc_id", "text", "source").toArrow())
    mixed = source_mixing.shuffled(source_mixing.copies(odd[1].select("doc_id", "text", "source")))
    got = Counter((r["doc_id"], r["source"], r["mix copies"], r["mix copy"], r["mix order"]) for r in mixed.collect())
    want = con.execute(source_mixing.SQL).fetchall()
    assert got == Counter((r[0], r[1], r[2], r[3], r[4]) for r in want)
    whole = source_mixing.mix_sources(odd[1], {"a": 3, "b": 1}, total=4000)
    assert whole.columns == odd[1].columns and {r["copy"] for r in whole.select("copy").distinct().collect()} == {7}
    shares = {r[0]: r[1] for r in whole.groupBy("source").count().collect()}
    assert set(shares) == {"a", "b"} and 0.6 < shares["a"] / 4000 < 0.9 and source_mixing.mix_sources(empty).count() == 0


def test_license_notices(spark, odd, empty):
    notice = "Licensed under the Apache License, Version 2.0."
    texts = [notice, ("filler word " * 300) + notice.lower() + " more of it " * 200, f"{notice}\n{notice}", "Released under the new MIT License today", "licensed cars under the bridge", None, "This work is licensed under the GNU General Public License, version 3."]
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["license"], r["n_notices"]) for r in got] == [("apache-2.0", 1), ("apache-2.0", 1), ("apache-2.0", 2), ("mit", 1), (None, 0), (None, 0), ("gpl-3.0", 1)]
    assert got[1]["first_word"] == 600 and got[1]["end_word"] == 608 and got[3]["coverage"] == 1.0
    assert license_scan.scan(odd[1]).count() == len(odd[0]) and license_scan.scan(empty).count() == 0


def test_each_license_under_its_own_name():
    model = license_scan.prepared(license_scan.TEMPLATES)

    def names(text):
        words, first = license_scan._words(*license_scan.text_rows(license_scan.pa.array([text], license_scan.pa.large_string())))
        return [model["names"][t] for _, t, *_ in license_scan.notices(words, first, model, license_scan.COVERAGE)]

    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "All rights reserved.": "rights reserved", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
        "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under CC BY 3.0": "cc-by-3.0",
        "Licensed under the GNU General Public License, version 2 or later": "gpl-2.0 terms", "Released under the ISC License": "isc",
        "This work is licensed under the GNU Lesser General Public License, version 2.1": "lgpl-2.1", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause tag",
    }
    for line, name in lines.items():
        assert names(f"Some prose before it.\n{line}\nAnd some after it.") == [name]
    for name, template in license_scan.TEMPLATES.items():
        assert names(f"Some prose before it. {template.text} And some after it.") == [name]
    assert names("Licensed under CC BY 2.7") == [] and names("all the words that one reserved") == []
    assert sorted(names("Licensed under CC BY 4.0 and Apache License, Version 2.0")) == ["apache-2.0", "cc-by-4.0"]
    whole = license_scan.TEMPLATES["lgpl-2.1 text"].text
    assert names(whole + " and " + whole.replace("any", "some")) == ["lgpl-2.1 text"] * 2


def test_patience_pairs():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = license_scan.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert license_scan.patience([1, 2, 3, 9, 4, 5], [1, 2, 8, 3, 4, 5]) == [(0, 0), (1, 1), (2, 3), (4, 4), (5, 5)]


@pytest.mark.parametrize("size", [0, 1, 2, 3, 10, 1000, 4097])
def test_feistel_is_a_permutation(size):
    assert sorted(training_order.feistel(np.arange(size), size, 11).tolist()) == list(range(size))


def test_training_records(odd, empty, tmp_path):
    import base64

    import tiktoken

    ordered = training_order.training_order(odd[1], length=64, per_shard=50)
    rows = ordered.collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and all(r["shard"] == r["slot"] // 50 and r["offset"] == r["slot"] % 50 * 128 for r in rows)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(training_order.VOCABULARY, "rb"))}
    encoding = tiktoken.Encoding("check", pat_str=training_order.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, text in odd[0]:
        ids = [*encoding.encode_ordinary(text or ""), training_order.END]
        for part in range(-(-len(ids) // 64)):
            piece = ids[64 * part : 64 * part + 64]
            want[i, part, len(piece), np.array(piece + [training_order.END] * (64 - len(piece)), "<u2").tobytes()] += 1
    assert Counter((r["doc_id"], r["part"], r["n_tokens"], bytes(r["record"])) for r in rows) == want
    made = training_order.write_shards(ordered, f"file://{tmp_path}/shards").collect()
    assert sum(m["records"] for m in made) == len(rows) and all(m["first_slot"] == 50 * m["shard"] for m in made)
    back = training_order.read_slots(f"file://{tmp_path}/shards", 37, 70, 64, 50)
    by_slot = {r["slot"]: bytes(r["record"]) for r in rows}
    assert [x.tobytes() for x in back] == [by_slot[s] for s in range(37, 107)]
    assert training_order.training_order(empty).count() == 0


def test_order_does_not_follow_the_partitions(odd):
    """Another split of the input gives every slot the same record, so a new run goes on where an old one stopped."""
    orders = [{r["slot"]: (r["doc_id"], r["part"], bytes(r["record"])) for r in training_order.training_order(odd[1].repartition(n), length=64, per_shard=50).collect()} for n in (1, 3, 5)]
    assert orders[0] == orders[1] == orders[2] and len(orders[0]) > 200


def test_training_shards_are_written(spark, odd, empty, tmp_path):
    """The registered query and the last stage return rows whose records stand at their places in files."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    for out in (training_order.op10_training_order(spark, folder), corpus_pipeline.records(spark, documents, folder), training_order.sharded_order(odd[1], f"file://{tmp_path}/s", length=64, per_shard=50)):
        rows = out.collect()
        files = {p: open(p, "rb").read() for p in {r["path"] for r in rows}}
        assert rows and all(files[r["path"]][r["offset"] :][: len(r["record"])] == r["record"] for r in rows)
        assert sum(map(len, files.values())) == sum(len(r["record"]) for r in rows) and len(files) == 1 + max(r["shard"] for r in rows)
    plain = training_order.training_order(odd[1], length=64, per_shard=50).collect()
    assert {tuple(r) for r in plain} == {tuple(r)[:-1] for r in rows}
    assert training_order.sharded_order(empty).count() == 0


def test_pipeline_stages(spark, odd):
    """Each stage keeps the columns and decides as its operator says; the last gives a record of every document that is left."""
    import corpus_pipeline

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "benchmark", "mixing", "records"] and corpus_pipeline.ORACLE_SQL is None
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality(spark, docs, folder)
    good = {r[0] for r in quality_rules.quality_report(docs).where("kept").select("doc_id").collect()}
    assert kept.columns == columns and {r[0] for r in kept.select("doc_id").collect()} == good
    kept = kept.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else kept
    single = corpus_pipeline.near_duplicates(spark, kept, folder)
    firsts = {r[0] for r in jaccard_join.similarity_classes(kept).where("doc_id = component_id").select("doc_id").collect()}
    assert single.columns == columns and {r[0] for r in single.select("doc_id").collect()} == firsts
    out = corpus_pipeline.run(spark, folder)
    assert set(out.columns) >= {"slot", "shard", "offset", "doc_id", "record"} and {r[0] for r in out.select("doc_id").distinct().collect()} <= firsts
