"""License notices in texts, by patience alignment with templates.

Words (lower-cased runs of digits, letters and non-ASCII characters) that are unique to a stretch of text and to a template are
anchors; the longest run of anchors that rises in both is kept, and the gaps between them are aligned in the same way, after equal
words at both ends of a gap have been paired. Coverage is the share of the template's words that are paired.

A notice counts only if the words that tell its license from others (name, version, NC, SA) are paired as well, and if none that would
make it another license stands within it. Of notices that share these words, the one with the most words paired less those missed is kept, so a header
within a whole text, or version 2.0 of a license that reads nearly like 2.1, is not found besides.

For short templates a text is looked at in stretches of a template's length and half as much again. A stretch is aligned only if enough of its words are
words of the template at all, which bounds the coverage from above; of stretches that overlap, those with the highest
bound come first. So each copy of a notice is found by itself, however long the text is or how often the notice is repeated. Where a template has
required words, only stretches around its rarest one are looked at. Templates of more than ``LONG`` words are aligned where three-word runs
that are unique to them suggest a copy, in texts that hold enough of their words; a copy without any such run isn't found.

Results for odd input: a null, empty or wordless text has no notice; rows that repeat a doc_id are scanned each; templates without words
are left out; other columns are ignored. Of notices with equal coverage the one whose template is longer, then whose name comes first, is the best.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trustlens.llm.flat import ALNUM_WORDS, LOWER, pieces, text_rows, word_hashes, word_spans
from trustlens.llm.license_texts import Template
from trustlens.llm.license_texts import templates as license_templates
from trustlens.llm.packed import keyed

COVERAGE = 0.8

LONG = 64

TEMPLATES = license_templates()


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    begin, end, first = word_spans(data, offsets, ALNUM_WORDS)
    return word_hashes(data, begin, end), first


def rising(values: list[int]) -> list[int]:
    """Places of a longest rising subsequence."""
    tails, places, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = places[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            places.append(i)
        else:
            tails[k], places[k] = v, i
    out, i = [], places[-1] if places else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs (place in a, place in b) of the alignment, in order."""
    pairs, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and in_b[w] == 1}
        unique = [(place[w], j) for j, w in enumerate(b[b0:b1], b0) if w in place]
        anchors = [unique[k] for k in rising([i for i, _ in unique])]
        if anchors:
            pairs += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(pairs)


def _runs(places: np.ndarray, base: int) -> np.ndarray:
    """A number for the three words from each place on; -1 where one of them is in no template."""
    a, b, c = places[:-2], places[1:-1], places[2:]
    return np.where((a < base) & (b < base) & (c < base), (a * base + b) * base + c, -1)


def prepared(templates: dict[str, str | Template]) -> dict:
    names = sorted(templates)
    table = [t if isinstance(t, Template) else Template(t) for t in (templates[n] for n in names)]
    words, first = _words(*text_rows(pa.array([x for t in table for x in t], pa.large_string())))
    vocabulary = np.unique(words)
    places = np.searchsorted(vocabulary, words)
    member = np.zeros((len(names), len(vocabulary) + 1), bool)
    model = {"names": names, "vocabulary": vocabulary, "member": member, "rows": [], "places": [], "required": [], "needed": [], "without": [], "runs": [], "counts": []}
    for i in range(len(names)):
        text, required, without = (slice(first[3 * i + k], first[3 * i + k + 1]) for k in range(3))
        row, asked = places[text], places[required].tolist()
        member[i, row] = True
        at: list[int] = []  # of a word asked for n times the first n places
        for w in asked:
            at += [int(x) for x in np.flatnonzero(row == w) if x not in at][:1]
        if len(at) != len(asked):
            raise ValueError(f"{names[i]}: a required word is not in the template")
        runs, begin, times = np.unique(_runs(row, len(vocabulary)), return_index=True, return_counts=True)
        model["rows"].append(words[text])
        model["places"].append(row)
        model["required"].append(frozenset(at))
        model["needed"].append(sorted(set(asked)))
        model["without"].append(places[without])
        model["runs"].append((runs[times == 1], begin[times == 1]))
        model["counts"].append(np.unique(row, return_counts=True))
    every = [r for (r, _), row in zip(model["runs"], model["rows"], strict=True) if len(row) > LONG]
    model["any run"] = np.unique(np.concatenate(every)) if every else np.zeros(0, np.int64)
    return model


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted table, -1 for none."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def _accepted(known: np.ndarray, model: dict, t: int, low: int, high: int, least: int) -> list[tuple[int, int]] | None:
    """Pairs of the template with the stretch, counted from low, if they make a notice."""
    pairs = patience(known[low:high].tolist(), model["places"][t].tolist())
    if len(pairs) < least or not model["required"][t] <= {j for _, j in pairs}:
        return None
    return None if np.isin(model["without"][t], known[low + pairs[0][0] : low + pairs[-1][0] + 1]).any() else pairs


def _short(known: np.ndarray, model: dict, t: int, low: int, high: int, ends: np.ndarray | int, least: int) -> Iterator[tuple[int, list]]:
    """(begin, pairs) of the notices that begin within low .. high; ends says where each one's row ends."""
    n = len(model["places"][t])
    total = np.concatenate([[0], np.cumsum(model["member"][t][known[low:high]])])
    stop = np.minimum(np.arange(low, high) + n + max(4, n // 2), ends) - low
    bound = total[stop] - total[:-1]
    candidates = np.flatnonzero((bound >= least) & (total[1:] > total[:-1]))  # a stretch begins with a word of the template
    taken = np.zeros(high - low, bool)
    for i in candidates[np.argsort(-bound[candidates], kind="stable")].tolist():
        if taken[i : stop[i]].any():
            continue
        pairs = _accepted(known, model, t, low + i, low + int(stop[i]), least)
        if pairs:
            taken[i + pairs[0][0] : i + pairs[-1][0] + 1] = True
            yield low + i, pairs


def _around(spots: list[np.ndarray], reach: int, first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows around the rarest word, where each other required word is within reach of it."""
    spots = sorted(spots, key=len)
    key = spots[0]
    for other in spots[1:]:
        at = np.searchsorted(other, key - reach)
        key = key[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] <= key + reach)] if len(other) else key[:0]
    if not len(key):
        return
    row = np.searchsorted(first, key, "right") - 1
    cuts = np.flatnonzero((np.diff(key) > 2 * reach) | (np.diff(row) > 0)) + 1
    for group in np.split(np.arange(len(key)), cuts):
        r = row[group[0]]
        yield max(int(first[r]), int(key[group[0]]) - reach), min(int(first[r + 1]), int(key[group[-1]]) + reach + 1)


def _long(known: np.ndarray, model: dict, t: int, low: int, high: int, at: np.ndarray, run: np.ndarray, least: int) -> Iterator[tuple[int, list]]:
    """(begin, pairs) of the copies of a long template in the row low .. high, where the words at the places ``at`` begin its runs ``run``."""
    n = len(model["places"][t])
    if high - low < least:
        return
    words, times = model["counts"][t]
    if np.minimum(np.bincount(known[low:high], minlength=len(model["vocabulary"]) + 1)[words], times).sum() < least:
        return
    begins, width, taken = at - model["runs"][t][1][run], max(4, n // 4), []
    bins, inside, hits = np.unique(begins // width, return_inverse=True, return_counts=True)
    for k in np.argsort(-hits, kind="stable").tolist():
        begin = int(np.median(begins[inside == k]))
        middle = begin + n // 2
        if any(a <= middle < b for a, b in taken):
            continue
        a = max([low, begin - width // 2, *(y for _, y in taken if y <= middle)])
        b = min([high, begin + n + width, *(x for x, _ in taken if x > middle)])
        pairs = _accepted(known, model, t, a, b, least) if b - a >= least else None
        if pairs:
            taken.append((a + pairs[0][0], a + pairs[-1][0] + 1))
            yield a, pairs


def notices(words: np.ndarray, first: np.ndarray, model: dict, coverage: float) -> list[tuple[int, int, int, int, float]]:
    """(row, template, begin, end, coverage) of the notices of a piece; those of one template do not overlap."""
    vocabulary, found = model["vocabulary"], []
    if not len(words) or not len(vocabulary):
        return []
    known = _among(words, vocabulary)
    known[known < 0] = len(vocabulary)
    if not (known < len(vocabulary)).any():
        return []
    order = np.argsort(known.astype(np.uint16 if len(vocabulary) < 1 << 16 else np.int64), kind="stable")
    spots = np.searchsorted(known[order], np.arange(len(vocabulary) + 1))
    runs = _runs(known, len(vocabulary)) if len(known) > 2 else np.zeros(0, np.int64)
    begun = np.flatnonzero(_among(runs, model["any run"]) >= 0)
    begun_rows = np.searchsorted(first, begun, "right") - 1
    ends = np.repeat(first[1:], np.diff(first))
    for t, row in enumerate(model["places"]):
        if not len(row):
            continue
        least = int(np.ceil(coverage * len(row)))
        needed = [order[spots[w] : spots[w + 1]] for w in model["needed"][t]]
        if any(not len(x) for x in needed):
            continue
        if len(row) > LONG:
            run = _among(runs[begun], model["runs"][t][0])
            mine = np.flatnonzero(run >= 0)
            for group in np.split(mine, np.flatnonzero(np.diff(begun_rows[mine])) + 1) if len(mine) else ():
                r = begun_rows[group[0]]
                found += [(t, a, pairs) for a, pairs in _long(known, model, t, int(first[r]), int(first[r + 1]), begun[group], run[group], least)]
        elif needed:
            for low, high in _around(needed, len(row) + max(4, len(row) // 2) - 1, first):
                found += [(t, a, pairs) for a, pairs in _short(known, model, t, low, high, high, least)]
        else:
            found += [(t, a, pairs) for a, pairs in _short(known, model, t, 0, len(known), ends, least)]
    return _without_parts(found, first, model)


def _without_parts(found: list[tuple[int, int, list]], first: np.ndarray, model: dict) -> list[tuple[int, int, int, int, float]]:
    """The notices that are not part of a better one: most words paired less those missed; then the name that comes first."""
    out, owner = [], {}
    for t, low, pairs in sorted(found, key=lambda f: (len(model["places"][f[0]]) - 2 * len(f[2]), f[0], f[1])):
        required = model["required"][t]
        telling = [low + i for i, j in pairs if j in required] if required else [low + i for i, _ in pairs]
        shares = Counter(x for place in telling for x in owner.get(place, ()) if out[x][1] != t)
        if any(n == len(telling) if required else 2 * n > len(telling) for n in shares.values()):
            continue
        for i, _ in pairs:
            owner.setdefault(low + i, []).append(len(out))
        out.append((int(np.searchsorted(first, low, "right") - 1), t, low + pairs[0][0], low + pairs[-1][0] + 1, len(pairs) / len(model["places"][t])))
    return out


def scan(documents: DataFrame, templates: dict[str, str | Template] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words, n_notices, license, coverage, first_word, end_word (of the best notice), licenses (all, sorted)."""
    model = prepared(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column(2)):
                words, first = _words(data, offsets)
                rows: list[tuple] = [(0, None, None, None, None, [])] * (high - low)
                by_row: dict[int, list] = {}
                for r, t, begin, end, share in notices(words, first, model, coverage):
                    by_row.setdefault(r, []).append((share, len(model["rows"][t]), t, begin - first[r], end - first[r]))
                for r, all_found in by_row.items():
                    share, _, t, begin, end = min(all_found, key=lambda x: (-x[0], -x[1], x[2], x[3]))
                    rows[r] = (len(all_found), model["names"][t], share, begin, end, sorted({model["names"][x[2]] for x in all_found}))
                columns = [pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(np.diff(first)), *columns], ["doc_id", "n_words", "n_notices", "license", "coverage", "first_word", "end_word", "licenses"]
                )

    return keyed(documents).mapInArrow(run, "doc_id bigint, n_words bigint, n_notices bigint, license string, coverage double, first_word bigint, end_word bigint, licenses array<string>")


def op9_license_alignment(spark, folder: str) -> DataFrame:
    return scan(spark.read.parquet(f"{folder}/documents.parquet"))
