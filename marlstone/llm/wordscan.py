"""Words of whole Arrow columns at once: the longest runs of a-z and 0-9 in the lower-cased text.

Hashing works on the column's bytes with numpy, so no Python object is made for a word. A word's number has
64 bits and depends on its bytes alone; equal words have equal numbers in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if "up" not in _powers or len(_powers["up"]) < n:
        m = max(n, 1 << 16) * 5 // 4
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            p = np.full(m, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def parts(texts: pa.Array | pa.ChunkedArray, most_bytes: int = 4 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) over the column, each slice of about most_bytes at most."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    if not len(sizes):
        return
    piece = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        yield a, texts.slice(a, b - a)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): row i holds bytes[offsets[i]:offsets[i + 1]]; nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def scan(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number, row, start, end) of every word, in order; start and end are bytes within the row's lower-cased text."""
    data, offsets = buffer(pc.utf8_lower(texts))
    none = np.zeros(0, np.int64)
    if not len(data):
        return none.astype(np.uint64), none, none, none
    word = _IS_WORD[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    before[heads] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    after[heads[heads > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    up, down = _power(len(data))
    total = np.cumsum(np.where(word, (data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], np.uint64(0)), dtype=np.uint64)
    number = total[ends - 1] - np.where(starts > 0, total[np.maximum(starts - 1, 0)], np.uint64(0))
    number = mix(number * down[starts])
    row = np.searchsorted(offsets, starts, side="right") - 1
    return number, row, starts - offsets[row], ends - offsets[row]


def number_of(word: str) -> int:
    """The number scan gives a single word."""
    return int(scan(pa.array([word]))[0][0])
