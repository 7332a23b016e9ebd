"""Quality rules: does a text's mix of characters and common words look like any language of the corpus?

For each text two histograms are made, of character classes and of common words (with one bucket for all other words). Each language of
the corpus with at least ``REFERENCE_TEXTS`` texts and ``REFERENCE_WORDS`` words has a reference, the summed histograms of all its texts.
A text is as far from good as its Jensen-Shannon distance (base 2, root of the divergence, 0 to 1) from the reference of its own
language. A text without a language is measured against the nearest reference; so are the characters of a text whose language has no
reference, but not its words, since the nearest language tells nothing of them. Short texts have noisy histograms: the character distance counts from
``MIN_CHARS`` word characters on, the word distance from ``MIN_WORDS`` words on.

Besides, base rules count words, symbols, repeated lines and words in repeated three-word windows; a text with fewer than 50 words, or
most of whose words are in repeated windows, fails.

Only DataFrame functions are used: a pass makes a digest of each text, the digests are summed to references (one row of about 800
bytes a language, whatever the table holds), and every digest is measured against them. Repeated windows are found by sorting one number per window, the upper
bits of its hash with its position in the lower ones, within the row.

Results for odd input: a null or empty text has no words and fails the base rules; texts without a language are measured but add to no
reference; without any reference nothing is too far; repeated rows are judged alike; an empty table gives no rows; extra columns are ignored or, in
``keep_good``, kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlens.llm.components import stored
from trustlens.llm.packed import text_key

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
MIN_CHARS = 200
MIN_WORDS = 150
MOST_CHAR_DISTANCE = 0.30
MOST_WORD_DISTANCE = 0.35
REFERENCE_TEXTS = 5  # a language with fewer texts
REFERENCE_WORDS = 1000  # or words has no reference, so a stray label changes no other verdict

#: The most frequent words of some languages; a text in another language has only the bucket of other words.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "it", "that", "was", "for", "on", "are", "as", "with", "be", "by", "this", "from", "at", "or", "an", "a", "not", "but"],
    "fr": ["le", "la", "de", "les", "des", "et", "en", "un", "une", "du", "que", "qui", "dans", "pour", "par", "sur", "au", "est", "pas", "ce", "il", "elle", "ne", "se"],
    "de": ["der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an", "aus", "er"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como", "más", "o"],
}
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})
CLASSES = 7
MARKS = r"[.,;:!?\"'()\[\]{}/\\@=+~^`_-]"
AROUND = ".,;:!?\"'()[]"  # taken off a word before it is looked up


def _text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, BLANK)).otherwise(F.array().cast("array<string>"))


def digests(documents: DataFrame) -> DataFrame:
    """The documents with a struct ``quality digest``: the base counts, the counts of the classes, the common words and their counts."""
    q = "quality digest"

    def col(name: str) -> Column:
        return F.col(f"{q} {name}")

    def then(frame: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
        """Add columns and keep only those of the earlier ones that are still needed: rows carry whole word lists here."""
        return frame.select(*own, *[col(k) for k in keep], *[c.alias(f"{q} {name}") for name, c in columns.items()])

    own = [F.col(f"`{c}`") for c in documents.columns]
    frame = then(documents, [], text=_text(F.col("text")))
    lines = F.filter(F.split(col("text"), "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    frame = then(
        frame, [], words=_words(col("text")), n_dup_lines=(F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"), n_symbols=F.regexp_count(col("text"), F.lit(SYMBOLS)).cast("bigint"),
        capitals=F.regexp_count(col("text"), F.lit("[A-Z]")), digits=F.regexp_count(col("text"), F.lit("[0-9]")), marks=F.regexp_count(col("text"), F.lit(MARKS)),
        chars=F.length(col("text")), wide=F.octet_length(col("text")) - F.length(col("text")),
    )
    counts = ["n_dup_lines", "n_symbols", "capitals", "digits", "marks", "chars", "wide"]
    plain = F.filter(F.transform(col("words"), lambda w: F.btrim(F.lower(w), F.lit(AROUND))), lambda w: w.isin(VOCABULARY))
    mask = (F.pow(F.lit(2.0), F.ceil(F.log2(F.size(col("words")) + 2.0))) - 1).cast("bigint")
    frame = then(frame, ["words", *counts], common=F.sort_array(plain), n_words=F.size(col("words")).cast("bigint"), word_chars=F.length(F.array_join(col("words"), "")).cast("bigint"), mask=mask)
    window = F.transform(
        col("words"),
        lambda w, i: F.xxhash64(w, F.get(col("words"), i + 1), F.get(col("words"), i + 2)).bitwiseAND(F.bitwise_not(col("mask"))).bitwiseOR(i.cast("bigint")),
    )
    windows = F.when(col("n_words") >= 3, F.sort_array(F.slice(window, F.lit(1), F.size(col("words")) - 2))).otherwise(F.array().cast("array<bigint>"))
    counts += ["n_words", "word_chars", "mask"]
    frame = then(frame, counts + ["common"], windows=windows, kinds=F.array_distinct(col("common")))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(a.bitwiseXOR(b).bitwiseAND(F.bitwise_not(col("mask"))) == 0, F.lit(False))

    repeated = F.filter(col("windows"), lambda x, i: same(x, F.get(col("windows"), i + 1)) | same(x, F.get(col("windows"), i - 1)))
    frame = then(
        frame, counts + ["common", "kinds"], starts=F.sort_array(F.transform(repeated, lambda x: x.bitwiseAND(col("mask")))), places=F.transform(col("kinds"), lambda w: F.array_position(col("common"), w))
    )
    covered = F.aggregate(F.transform(col("starts"), lambda x, i: F.least(F.lit(3), F.coalesce(F.get(col("starts"), i + 1) - x, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, b: a + b)
    found = F.transform(
        col("kinds"),
        lambda w, i: F.struct((F.array_position(F.lit(VOCABULARY), w) - 1).cast("int").alias("at"), (F.coalesce(F.get(col("places"), i + 1), F.size(col("common")) + 1) - F.get(col("places"), i)).alias("n")),
    )
    rest = col("word_chars") - col("capitals") - col("digits") - col("marks") - col("n_symbols")
    classes = F.array(*(x.cast("double") for x in (rest, col("capitals"), col("digits"), col("n_symbols"), col("marks"), col("wide"), col("chars") - col("word_chars"))))
    digest = F.struct(
        *(col(k).alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines")), covered.alias("n_repeat_words"), classes.alias("classes"),
        found.alias("common"), F.size(col("common")).alias("n_common"),
    )
    return frame.select(*own, digest.alias(q))


def references(digested: DataFrame) -> DataFrame:
    """One row with ``refs``: an array of (lang, shares of the classes, shares of the vocabulary and of other words)."""
    rows = digested.select(F.col("lang").cast("string").alias("lang"), F.col("quality digest").alias("d")).where("lang is not null")
    summed = rows.groupBy("lang").agg(
        F.count("*").alias("texts"), F.sum("d.n_words").cast("double").alias("n"), F.sum("d.n_common").cast("double").alias("listed"), F.array(*(F.sum(F.col("d.classes")[i]) for i in range(CLASSES))).alias("c")
    )
    counted = rows.select("lang", F.explode("d.common").alias("w")).groupBy("lang", "w.at").agg(F.sum("w.n").cast("double").alias("n"))
    words = counted.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("w"))  # at most one entry per word of the vocabulary
    total = F.aggregate("c", F.lit(0.0), lambda a, b: a + b)
    joined = summed.join(words, "lang", "left").where((total > 0) & (F.col("n") >= REFERENCE_WORDS) & (F.col("texts") >= REFERENCE_TEXTS))
    shares = F.concat(
        F.transform(F.sequence(F.lit(0), F.lit(len(VOCABULARY) - 1)), lambda i: F.coalesce(F.try_element_at(F.col("w"), i), F.lit(0.0)) / F.col("n")), F.array((F.col("n") - F.col("listed")) / F.col("n"))
    )
    shared = joined.select("lang", F.transform("c", lambda x: x / total).alias("c"), shares.alias("w"))
    return shared.agg(F.sort_array(F.collect_list(F.struct("lang", "c", "w"))).alias("refs"))


def _part(p: Column, q: Column) -> Column:
    """Twice the divergence that one bucket adds, less the q that empty buckets add."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log2(q / m)).otherwise(F.lit(0.0)) - q


def _nearest(refs: Column, parts) -> Column:
    """Distance from the nearest reference; parts(ref) sums _part over the buckets that the text has."""
    return F.array_min(F.transform(refs, lambda r: F.sqrt(F.greatest((F.lit(1.0) + parts(r)) / 2, F.lit(0.0)))))


def judged(digested: DataFrame, refs: DataFrame) -> DataFrame:
    """The digest replaced by a struct ``quality`` of measures and verdict."""
    frame = digested.join(F.broadcast(refs.select(F.col("refs").alias("quality refs"))))  # one row
    d = F.col("quality digest")
    size = F.aggregate(d["classes"], F.lit(0.0), lambda a, b: a + b)
    words = d["n_words"].cast("double")
    own_ref = F.filter("quality refs", lambda r: r["lang"] == F.col("lang").cast("string"))
    known = F.coalesce(F.size(own_ref) > 0, F.lit(False))
    refs = F.when(known, own_ref).otherwise(F.col("quality refs"))
    far_chars = _nearest(refs, lambda r: F.aggregate(F.zip_with(d["classes"], r["c"], lambda x, y: _part(x / size, y)), F.lit(0.0), lambda a, b: a + b))
    far_words = _nearest(
        refs,
        lambda r: F.aggregate(d["common"], F.lit(0.0), lambda a, s: a + _part(s["n"] / words, F.get(r["w"], s["at"]))) + _part((words - d["n_common"]) / words, F.element_at(r["w"], -1)),
    )
    own = [F.col(f"`{c}`") for c in digested.columns if c != "quality digest"]
    far = frame.select(
        *own, "quality digest", F.when((d["word_chars"] >= MIN_CHARS) & (size > 0), far_chars).alias("quality chars"), F.when((d["n_words"] >= MIN_WORDS) & (known | F.col("lang").isNull()), far_words).alias("quality words")
    )
    failed = (d["n_words"] < 50) | (100 * d["n_repeat_words"] > 50 * d["n_words"])
    good = (F.coalesce("quality chars", F.lit(0.0)) <= MOST_CHAR_DISTANCE) & (F.coalesce("quality words", F.lit(0.0)) <= MOST_WORD_DISTANCE)
    return far.select(
        *own,
        F.struct(
            *(d[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed.alias("base_failed"), (~failed & good).alias("kept"),
            F.col("quality chars").alias("char_distance"), F.col("quality words").alias("word_distance"),
        ).alias("quality"),
    )


def quality_report(documents: DataFrame) -> DataFrame:
    """doc_id, the base counts, both distances (null below the length guards) and the verdict. The texts are read once."""
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    digested = stored(digests(texts).drop("text"), "quality")
    return judged(digested, references(digested)).select("doc_id", "quality.*")


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that pass, all columns as they were."""
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(), "text", "lang")
    digested = stored(digests(texts).drop("text"), "quality")
    passed = judged(digested, references(digested)).where("quality.kept").select(F.col("doc_id").alias("passed id"), F.col("text_key").alias("passed key")).distinct()
    rows = documents.withColumn("quality id", F.col("doc_id").cast("bigint")).withColumn("quality key", text_key())
    kept = rows.join(passed, F.col("quality id").eqNullSafe(F.col("passed id")) & (F.col("quality key") == F.col("passed key")), "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in documents.columns])


def op1_quality_divergence(spark, folder: str) -> DataFrame:
    return quality_report(spark.read.parquet(f"{folder}/documents.parquet"))
