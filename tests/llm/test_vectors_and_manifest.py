"""Nearest neighbours, Merkle manifest and whitening against plain versions, with every odd case."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.compare import compare
from trustlens.llm import merkle, nearest, vectors, whitening

VECTORS = "vec_id long, embedding array<double>, label int, hash string, vector string, x int, kind int, block string, digest int"
EXTRA = (1, "h", "v", 2, 3, "b", 4)


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], VECTORS).repartition(4)


def odd_vectors(seed=4, n=400, length=6):
    rng = np.random.default_rng(seed)
    made = [(i, (rng.standard_normal(length) * (10 if i % 50 == 0 else 1)).tolist()) for i in range(n)]
    made += [(n + i, made[3][1]) for i in range(60)]  # one vector shared by many rows
    made += [(7, made[7][1])] * 3 + [(7, [0.5] * length), (None, made[5][1])]  # repeated rows, an id with two vectors, no id
    bad = [None, [], [0.0] * length, [1.0, None] + [0.0] * (length - 2), [float("nan")] * length, [float("inf")] + [0.0] * (length - 1), [1.0, 2.0]]
    return made, [(1000 + i, v) for i, v in enumerate(bad)]


def test_usable_vectors(spark):
    good, bad = odd_vectors()
    rows, length = vectors.finite_vectors(table(spark, good + bad))
    assert length == 6 and rows.count() == len(good) + 1 and rows.columns == ["vec_id", "vector"]  # the zero vector is finite
    assert vectors.finite_vectors(table(spark, []))[1] == 0
    assert vectors.finite_vectors(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id int, embedding array<float>"))[1] == 2


def brute(rows, top, divisor):
    distinct = sorted({(i, tuple(v)) for i, v in rows if i is not None})
    matrix = np.array([v for _, v in distinct])
    out = {}
    for k, (i, _) in enumerate(distinct):
        if i % divisor == 0:
            scores = matrix @ matrix[k]
            out[i, distinct[k][1]] = sorted(((-round(s, 9), j) for c, (s, (j, _)) in enumerate(zip(scores, distinct, strict=True)) if c != k))[:top]
    return out


def listed(frame):
    out = defaultdict(list)
    for r in frame.collect():
        out[r["query_id"]].append((r["rank"], -round(r["score"], 9), r["vec_id"]))
    return {q: sorted(found) for q, found in out.items()}


@pytest.mark.parametrize("block", [10_000, 90])
def test_nearest_is_exact_when_the_whole_recall_is_asked_for(spark, block):
    """With a recall of 1 hardly a candidate is left out: ties, repeated rows and the order are those of brute force."""
    good, bad = odd_vectors(n=200)
    found = listed(nearest.nearest(table(spark, good + bad), F.col("vec_id") % 10 == 0, top=15, trees=40, block=block, recall=1.0))
    expected = {q: [(r + 1, *x) for r, x in enumerate(best)] for (q, _), best in brute(good, 15, 10).items()}
    assert set(found) == set(expected)
    same = sum(len(set(found[q]) & set(expected[q])) for q in expected)
    assert same >= 0.97 * sum(map(len, expected.values()))
    assert all([r for r, *_ in f] == list(range(1, 16)) and [x[1:] for x in f] == sorted(x[1:] for x in f) for f in found.values())


def test_all_candidates_if_there_are_few(spark):
    rows = [(20 * i, [float(i + 1), 1.0, 0.0]) for i in range(5)] + [(3, [1.0, 1.0, 0.0]), (4, [0.0, 0.0, 1.0])]
    found = listed(nearest.nearest(table(spark, rows), F.col("vec_id") % 20 == 0))
    expected = {q: [(r + 1, *x) for r, x in enumerate(best)] for (q, _), best in brute(rows, 20, 20).items()}
    assert found == expected and len(found) == 5 and all(len(f) == 6 for f in found.values())
    alone = nearest.nearest(table(spark, [(20, [1.0, 2.0])]), F.col("vec_id") % 20 == 0)
    assert alone.count() == 0 and nearest.nearest(table(spark, []), F.lit(True)).count() == 0
    assert nearest.nearest(table(spark, [(21, [1.0, 2.0])]), F.col("vec_id") % 20 == 0).count() == 0


def test_own_row_and_copies(spark):
    """A hot vector lists its copies by id; the query's own row is never among them, another row with its id is."""
    rows = [(i, [1.0, 0.5]) for i in range(100)] + [(0, [2.0, 1.0]), (200, [-1.0, 0.0])]
    found = listed(nearest.nearest(table(spark, rows), F.col("vec_id") == 40, top=5))
    assert [x[2] for x in found[40]] == [0, 0, 1, 2, 3]
    assert 40 not in {x[2] for x in listed(nearest.nearest(table(spark, rows), F.col("vec_id") == 40, top=200))[40]}


def test_recall_on_unstructured_vectors(spark):
    rng = np.random.default_rng(9)
    data = rng.standard_normal((4000, 24))
    data[:1300] = data[0] + 0.2 * data[:1300]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    found = nearest.nearest(frame, F.col("vec_id") % 20 == 0, block=1500).groupBy("query_id").agg(F.collect_list("vec_id")).collect()
    data, hits = data.astype(np.float32).astype(float), 0
    for q, ids in found:
        scores = data @ data[q]
        scores[q] = -np.inf
        hits += len(set(ids) & set(np.argsort(-scores)[:20].tolist()))
    assert len(found) == 200 and hits >= 0.9 * 4000


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves, arity):
    """Root and the siblings of each leaf, from below."""
    nodes, under, paths = leaves, [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(nodes) > 1:
        above, groups = [], []
        for low in range(0, len(nodes), arity):
            run = nodes[low : low + arity]
            for k in range(len(run)):
                for leaf in under[low + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(digest("".join(run)))
            groups.append(sum(under[low : low + arity], []))
        nodes, under = above, groups
    return nodes[0], paths


def documents():
    rng = random.Random(3)
    texts = [None, "", "\n\n", "a\nb", "é" * 50 + "\n", "long " * 20_000 + "\n", "plain"]
    rows = [(i, rng.choice(texts), rng.choice(["hot", "hot", "hot", "b", "é", "", "z\n"]), rng.choice(["en", None]), rng.choice([None, i])) for i in range(260)]
    rows += [(5000, "alone\n", "single", "en", 3), (5001, "no source\n", None, "en", 3), (5002, None, None, None, None)]
    rows += [(None, "no id\n", "hot", "en", 1), (None, "no id\n", "hot", "en", 1), (17, "again", "hot", None, None), rows[4], rows[4]]
    return rows


def plain_manifest(rows, arity):
    by = defaultdict(list)
    for i, text, source, lang, n in rows:
        leaf = plain_leaf((i, source, lang, n, text))
        even = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        given = plain_leaf((i, source, lang, n, text.replace("\n", "") if even and text is not None else text))
        by[source].append((i is not None, i or 0, leaf, given))
    keys = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by[s])], arity) for s in keys}
    root, upper = plain_tree([trees[s][0] for s in keys], arity)
    out = Counter()
    for place, s in enumerate(keys):
        for x, own in zip(sorted(by[s]), trees[s][1], strict=True):
            path, node = own + upper[place], x[3]
            for before, after in path:
                node = digest(before + node + after)
            out[x[1] if x[0] else None, x[2], trees[s][0], root, digest("".join(a + b for a, b in path)), node, node == root] += 1
    return out


@pytest.fixture
def manifest_folder(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def test_manifest_equals_a_plain_one_and_its_sql(spark, manifest_folder):
    folder = manifest_folder(documents())
    frame = merkle.op12_merkle_manifest(spark, folder)
    found = frame.collect()
    expected = plain_manifest(documents(), 3)
    assert Counter(map(tuple, found)) == expected and len({k[3] for k in expected}) == 1
    assert any(k[-1] for k in expected) and not all(k[-1] for k in expected)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(documents(), columns=["doc_id", "text", "source", "lang", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"}))
    result = con.execute(merkle.SQL)
    assert compare(frame.columns, found, [d[0] for d in result.description], result.fetchall()) == ""


@pytest.mark.parametrize("arity", [2, 4])
def test_other_arities(spark, arity):
    rows = documents()
    frame = spark.createDataFrame([(*r, 1, 2, b"x") for r in rows], "doc_id long, text string, source string, lang string, n_chars long, g int, idx int, digest binary")
    found = merkle.verified(merkle.proofs(frame, arity=arity), "digest").select("key", F.hex("digest"), F.hex("subroot"), F.hex("root"), F.hex(merkle.path_digest(F.col("path"))), "verified").collect()
    assert Counter((r[0], *(x.lower() for x in r[1:5])) for r in found) == Counter(k[:5] for k in plain_manifest(rows, arity).elements())
    assert all(r["verified"] for r in found)


def test_manifest_of_little(spark, manifest_folder):
    one = [(8, "a\nb", None, None, None)]
    found = merkle.proofs(spark.createDataFrame(one, "doc_id long, text string, source string, lang string, n_chars long")).first()
    assert found["digest"] == found["subroot"] == found["root"] and found["path"] == []
    assert merkle.op12_merkle_manifest(spark, manifest_folder([])).count() == 0


def plain_whitening(rows, count):
    x = {i: np.floor(64 * np.array(v)).astype(object).astype(int) + 1_000_000 for i, (_, v) in enumerate(rows)}
    fit = np.array(sorted({tuple(int(c) for c in v) for v in x.values()}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums).astype(float) / n
    covariance = centred.T @ centred / n
    values, found = np.linalg.eigh(covariance)
    values, found = values[::-1][:count], found[:, ::-1][:, :count]
    rows_of = np.array([x[i] for i in range(len(rows))], dtype=object) * n - sums
    return n, (rows_of**2).sum(axis=1).tolist(), rows_of.astype(float) / n @ (found / np.sqrt(values)), values / np.trace(covariance)


def test_whitening_equals_a_plain_one(spark):
    rng = np.random.default_rng(8)
    scales = np.array([5, 4, 3, 2.5, 2, 1.5, 1, 0.8, 0.6, 0.5, 0.4, 0.3])
    rows = [(i, (rng.standard_normal(12) * scales).tolist()) for i in range(500)] + [(500 + i, [0.25] * 12) for i in range(200)] + [(3, [1.0] * 12), (None, [2.0] * 12), (9, [0.0] * 12)]
    bad = [(1000, None), (1001, []), (1002, [None] * 12), (1003, [float("nan")] * 12), (1004, [float("-inf")] + [1.0] * 11), (1005, [1.0])]
    found = whitening.whiten(table(spark, rows + bad), count=8).collect()
    n, deviations, whitened, explained = plain_whitening(rows, 8)
    assert len(found) == 8 * len(rows) and {r["n"] for r in found} == {n}
    assert Counter((r["vec_id"], r["deviation"]) for r in found) == Counter((i, d) for (i, _), d in zip(rows, deviations, strict=True) for _ in range(8))
    own = {r["component"]: {} for r in found}
    for r in found:
        own[r["component"]][r["vec_id"], r["deviation"]] = r["whitened"]
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9) and r["identity_error"] < 1e-9
    for c in range(1, 9):
        got = np.array([own[c][i, d] for (i, _), d in zip(rows, deviations, strict=True)])
        sign = np.sign(got @ whitened[:, c - 1])
        assert np.abs(got * sign - whitened[:, c - 1]).max() < 1e-8


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(table(spark, [])).count() == 0 and whitening.whiten(table(spark, [(1, None)])).count() == 0
    same = whitening.whiten(table(spark, [(i, [1.0, 2.0, 3.0]) for i in range(4)])).collect()
    assert len(same) == 12 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(1, 0, None, 0.0, 0.0)}
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i]) for i in range(9)])).collect()  # one direction only
    assert {r["component"]: r["whitened"] is None for r in line} == {1: False, 2: True}
    huge = {(r["vec_id"], r["component"]): r for r in whitening.whiten(table(spark, [(1, [1e300, 1.0]), (2, [-1e300, 3.0]), (3, [0.0, 2.0])])).collect()}
    assert huge[1, 1]["deviation"] is None and np.isfinite(huge[1, 1]["whitened"])
    wide = [(i, [float(i) * 2e4, float(i * i)]) for i in range(50)]  # sums that need exact numbers
    _, deviations, _, _ = plain_whitening(wide, 2)
    assert {r["vec_id"]: r["deviation"] for r in whitening.whiten(table(spark, wide)).collect()} == dict(enumerate(deviations))


def test_components_of_hard_matrices():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    low = rng.standard_normal((6, 30))
    cases = [np.eye(20), np.diag([3.0, 3, 3, 1, 1, 0]), np.ones((30, 30)), q @ np.diag([5.0] * 10 + [4.9999999] * 10 + [1e-8] * 20) @ q.T, low.T @ low, np.diag(10.0 ** -np.arange(20)), np.zeros((3, 3)), np.array([[2.0]])]
    for a in cases:
        values, found = whitening.leading_components(a, 16)
        norm = np.abs(a).max() or 1
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1][: len(values)]).max() < 1e-12 * norm
        assert np.abs(found.T @ found - np.eye(len(values))).max() < 1e-10 and np.abs(a @ found - found * values).max() < 1e-10 * norm
