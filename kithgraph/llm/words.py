"""Words and word shingles of whole Arrow batches, by numpy over the UTF-8 bytes.

A word is a run of bytes other than space and \\x09-\\x0D. Those are single bytes in UTF-8 and
occur in no other character, so that the bytes need not be decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one pass handles, so that its arrays stay in the processor's cache.
CHUNK = 1 << 19
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240517))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_LOWER_VALUE = _VALUE.copy()
_LOWER_VALUE[65:91] = _VALUE[97:123]
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        ones = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        for x in ones:
            x[0] = 1
        _powers[:] = [np.multiply.accumulate(x) for x in ones]
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of consecutive documents: hash, byte range, and for each document the range of its words."""

    first: int  # index of the first document in its batch
    data: np.ndarray  # bytes of all texts
    text_at: np.ndarray  # n + 1 byte offsets of the texts
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    word_at: np.ndarray  # n + 1 offsets of the documents' words

    def __len__(self) -> int:
        return len(self.word_at) - 1


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def spans(at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes together, one document at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words_of(column: pa.Array, lower: bool = True, limit: int = CHUNK) -> Iterator[Words]:
    at, data = text_buffers(column)
    value = _LOWER_VALUE if lower else _VALUE
    for i, j in spans(at, limit):
        part = data[at[i] : at[j]]
        text_at = at[i : j + 1] - at[i]
        inside = ~_SPACE[part]
        before = np.empty(len(part) + 1, bool)
        before[0] = False
        before[1:] = inside
        cut = text_at[:-1]
        cut = cut[cut < len(part)]
        opens = inside & ~before[:-1]
        opens[cut] = inside[cut]
        closes = np.empty(len(part) + 1, bool)  # at the byte after a word
        closes[:-1] = before[:-1] & ~inside
        closes[cut] = before[cut]
        closes[len(part)] = before[len(part)] if len(part) else False
        start, end = np.flatnonzero(opens), np.flatnonzero(closes)
        power, inverse = _tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(value[part] * power[: len(part)], out=sums[1:])
        hashed = mix((sums[end] - sums[start]) * inverse[start])
        yield Words(i, part, text_at, start, end, hashed, np.searchsorted(start, text_at))


def runs(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each word on, and whether they end in the same document."""
    n = len(w.hash)
    if n < size:
        return np.zeros(n, np.uint64), np.zeros(n, bool)
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total += w.hash[k : n - size + 1 + k] * _STEP[k]
    out = np.zeros(n, np.uint64)
    out[: n - size + 1] = mix(total)
    ends = np.repeat(w.word_at[1:], np.diff(w.word_at))
    return out, np.arange(n) + size <= ends


def whole(words: np.ndarray) -> np.uint64:
    """Hash of a short text's words as one sequence."""
    return mix((words * _STEP[32 : 32 + len(words)]).sum(dtype=np.uint64, keepdims=True) + _U(len(words)))[0]


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(document's index, its sorted distinct shingle hashes); with fewer words than ``size`` the whole sequence is one."""
    for w in words_of(column):
        hashed, valid = runs(w, size)
        for k in range(len(w)):
            a, b = w.word_at[k], w.word_at[k + 1]
            if b - a >= size:
                yield w.first + k, np.unique(hashed[a : b - size + 1])
            elif b > a:
                yield w.first + k, whole(w.hash[a:b]).reshape(1)
            else:
                yield w.first + k, np.zeros(0, np.uint64)
