"""Arrow text columns as flat byte arrays: words, their hashes and the hashes of word or byte windows.

A batch is handled in pieces of a few MB (at least one whole text), so memory does not follow the batch.
All hashes are 64 bit and the same on every machine. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20

_P, _Q = 0x9E3779B97F4A7C15 | 5, 0xD6E8FEB86659FD93 | 5
_seeds = np.random.default_rng(20240131).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BLANK_WORDS = ~SPACE  # [^\x20\x09-\x0D]+
ALNUM_WORDS = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, made once a process and as far as needed; functions sent to tasks take none along."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self) -> tuple[type, tuple[int]]:
        return type(self), (self.base,)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), PIECE + 4096)
            self.up, self.down = (
                np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64), dtype=np.uint64)]) for b in (self.base, self.inverse)
            )


_bytes, _words = _Powers(_P), _Powers(_Q)


def text_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of groups of whole texts."""
    data, offsets = text_rows(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every maximal run of marked bytes within a text, and each row's first word."""
    marked = inside[data]
    begin, end = marked.copy(), marked.copy()
    begin[1:] &= ~marked[:-1]
    end[:-1] &= ~marked[1:]
    full = offsets[:-1] < offsets[1:]
    head, tail = offsets[:-1][full], offsets[1:][full] - 1
    begin[head] = marked[head]
    end[tail] = marked[tail]
    begin = np.flatnonzero(begin)
    return begin, np.flatnonzero(end) + 1, np.searchsorted(begin, offsets)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _bytes.grow(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_seeds[data] * _bytes.up[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * _bytes.down[begin] + (end - begin).astype(np.uint64))


def window_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and row of every window of k items that lies within a row."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - (ends - counts)[rows] + first[:-1][rows], rows


def window_hashes(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k items from each start."""
    _words.grow(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _words.up[: len(hashes)], out=total[1:])
    return mix((total[starts + k] - total[starts]) * _words.down[starts] + np.uint64(k))


def byte_window_hashes(data: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each start."""
    return word_hashes(data, starts, starts + k)


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """For every i the leftmost place of the least of values[i : i + w]; the last w - 1 have none."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, place, span = values, np.arange(len(values)), 1
    while span < w:
        step = min(span, w - span)
        right = least[step:] < least[: len(least) - step]
        place = np.where(right, place[step:], place[: len(place) - step])
        least = np.where(right, least[step:], least[: len(least) - step])
        span += step
    return place[:n]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
