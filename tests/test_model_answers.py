"""Levels of a model answer and the mending of malformed objects."""

import json
import random

import pytest
from pyspark.sql import functions as F

from trustlens.functions import mending
from trustlens.operators import model_answers as J

BROKEN = [
    ('{"a": 1, "b": [1, 2,], }', {"a": 1, "b": [1, 2]}),
    ('{"a": 1,, "b": "x",, }', {"a": 1, "b": "x"}),
    ("{a: 1, b: two words, c: True, d: None}", {"a": 1, "b": "two words", "c": True, "d": None}),
    ("{'a': 'don't', 'b': 'say \"x\"'}", {"a": "don't", "b": 'say "x"'}),
    ('{"a": “curly”, "b": 2}', {"a": "curly", "b": 2}),
    ('{"a": "he said "hi" there", "b": "one", "c": "two "x", or "y", three"}', {"a": 'he said "hi" there', "b": "one", "c": 'two "x", or "y", three'}),
    ('{"a": {"b": [1, {"c": 2', {"a": {"b": [1, {"c": 2}]}}),
    ('{"a": "cut of', {"a": "cut of"}),
    ('{"a": 1, "b', {"a": 1, "b": ""}),
    ('{"a": "end\\', {"a": "end"}),
    ('{"a" 1 "b" "x"\n"c": [1 2]}', {"a": 1, "b": "x", "c": ["1 2"]}),
    ('{"a": "x" "b": "y"}', {"a": "x", "b": "y"}),
    ('{"a": 1, // note: x, "y"\n "b": 2 # more\n}', {"a": 1, "b": 2}),
    ('{"a": [{"b": 1], "c": 2}', {"a": [{"b": 1}], "c": 2}),
    ('{"a":, "b"}', {"a": "", "b": ""}),
    ('{"a": 1}} and then {"b": 2}', {"a": 1}),
    ('{"a": "line\nbreak\ttab\x01"}', {"a": "line\nbreak\ttab"}),
    ('{"a": "bad \\d \\u12 \\u00e9 \\" \\\\"}', {"a": 'bad d u12 é " \\'}),
    ('{"a": 007, "b": .5, "c": -1.5e5, "d": 85%}', {"a": "007", "b": ".5", "c": -150000.0, "d": "85%"}),
    ("{", {}),
    ("{} {", {}),
]


def mend(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, s string").repartition(3)
    return [json.loads(r["m"]) for r in frame.select("i", mending.mended(F.col("s")).alias("m")).orderBy("i").collect()]


def test_broken_objects(spark):
    for (text, wanted), got in zip(BROKEN, mend(spark, [t for t, _ in BROKEN]), strict=True):
        assert got == wanted, text


def random_object(rng, depth=0):
    text = lambda: "".join(rng.choice('ab "\\\n,:{}[]é\'#/“') for _ in range(rng.randrange(12)))
    plain = lambda: "".join(rng.choice("abc d") for _ in range(rng.randrange(1, 9))).strip() or "x"
    value = lambda: rng.choice([lambda: rng.randrange(-99, 99), lambda: rng.random(), plain, text, lambda: rng.choice([True, False, None]), lambda: [value() for _ in range(rng.randrange(4))] if depth < 9 else 1, lambda: random_object(rng, depth + 1)])() if depth < 4 else rng.randrange(9)
    return {plain() + str(k): value() for k in range(rng.randrange(5))}


def test_valid_objects_stay_and_cut_ones_are_closed(spark, monkeypatch):
    """Valid JSON keeps its meaning, and whatever it is cut to is an object again whose plain values are those of the whole."""
    monkeypatch.setattr(mending, "PIECE", 7)  # so that outputs are put together from pieces
    rng = random.Random(6)
    objects = [random_object(rng) for _ in range(120)]
    whole = [json.dumps(o, ensure_ascii=k % 2 == 0, indent=1 if k % 3 == 0 else None) for k, o in enumerate(objects)]
    plain = ['"' not in json.dumps(list(_texts(o))).replace('", "', "").strip('["]') and not set("\\\"'“,:{}[]#/\n") & set("".join(_texts(o))) for o in objects]
    got = mend(spark, whole)
    assert sum(plain) > 20
    for o, g, easy in zip(objects, got, plain, strict=True):
        assert isinstance(g, dict) and (not easy or g == o)
    cuts = [(k, w[: rng.randrange(1, len(w) + 1)]) for k, w in enumerate(whole) for _ in range(4)]
    for (k, _), g in zip(cuts, mend(spark, [c for _, c in cuts]), strict=True):
        assert isinstance(g, dict)
        if plain[k]:
            firsts = list(g)[:-1]  # the last one may be cut
            assert firsts == list(objects[k])[: len(firsts)] and all(g[f] == objects[k][f] for f in firsts)


def _texts(value):
    if isinstance(value, dict):
        for k, v in value.items():
            yield k
            yield from _texts(v)
    elif isinstance(value, list):
        for v in value:
            yield from _texts(v)
    elif isinstance(value, str):
        yield value


def test_long_texts(spark):
    """A long text, many tokens and deep brackets: time follows the length."""
    long = '{"a": "' + "word " * 60_000 + '", "b": [' + "1, " * 20_000 + '], "c": ' + "[" * 300
    got = mend(spark, [long])[0]
    assert len(got["a"]) == 300_000 and got["b"] == [1] * 20_000 and json.dumps(got["c"]).count("[") == 300


@pytest.mark.parametrize(
    "text, level, toxicity, flags",
    [
        ('{"toxicity": 5, "red_flags": ["a"]}', "json", 5, ["a"]),
        ('before {"toxicity": 5} after {', "json", 5, []),
        ('{"other": 1} toxicity: 7', "json", 0, []),
        ("{}", "json", 0, []),
        ("{'toxicity': 5}", "repaired", 5, []),
        ('text {"toxicity": 5, "red_flags": ["a", "b"', "repaired", 5, ["a", "b"]),
        ("{curly} toxicity: 5", "repaired", 0, []),
        ('Toxicity: 4\nred_flags: ["x", "y"]', "fields", 4, ["x", "y"]),
        ("nothing", "failed", 0, []),
        ("  ", "empty", 0, []),
        ("", "empty", 0, []),
    ],
)
def test_levels(spark, text, level, toxicity, flags):
    got = J.flat_fields(J.answer_fields(spark.createDataFrame([(text,)], "response string"))).first()
    assert (got["level"], got["toxicity"], got["red_flags"]) == (level, toxicity, flags)


def test_null_answer(spark):
    got = J.flat_fields(J.answer_fields(spark.createDataFrame([(None,)], "response string"))).first()
    assert got["toxicity"] == 0 and got["level"] == "failed"
