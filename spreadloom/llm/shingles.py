"""Hashes of word shingles, computed for a whole Arrow batch at once from the bytes of its text column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_random = np.random.default_rng(20)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) | U(1)  # what a byte stands for in a word's hash
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2**64)
_PLACE = _random.integers(1, 2**63, 16, dtype=np.uint64) | U(1)  # a word's place in a shingle


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """base^i and base^-i for i below n, modulo 2^64."""
    while len(_powers[0]) < n:
        m = len(_powers[0])
        for k, b in enumerate((_BASE, _UNBASE)):
            _powers[k] = np.concatenate([_powers[k], _powers[k] * U(pow(b, m, 2**64))])
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null rows are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same of the text in lower case, letters of all scripts included."""
    import pyarrow.compute as pc

    return text_bytes(pc.utf8_lower(column.cast(pa.large_string())))


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word, and for each row the number of words before it. Words are runs without the bytes
    0x20 and 0x09-0x0D, or without those that ``space`` marks; A-Z count as a-z. No word crosses rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = _power(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:n])])
    words = mix((sums[ends] - sums[starts]) * down[starts] + U(1) * (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its k-word shingles; a row of fewer words has its whole
    sequence as its only one; a row without words has none."""
    words, at = word_hashes(*text_bytes(column))
    joint = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        joint += words[i : i + len(joint)] * _PLACE[i]
    joint = mix(joint)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(joint[a : b - k + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + U(b - a)))
        else:
            out.append(joint[:0])
    return out


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1_000_000):
    """Parts of a batch with about ``most`` bytes of text, so that very long texts don't multiply in memory: hashing takes
    some 40 bytes for each, 16 of which a worker keeps as powers."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin, size = 0, 0
    for i, n in enumerate(lengths):
        size += n
        if size >= most:
            yield batch.slice(begin, i + 1 - begin)
            begin, size = i + 1, 0
    if begin < len(lengths):
        yield batch.slice(begin)
