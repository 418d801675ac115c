"""Vectorised helpers over the UTF-8 bytes of Arrow string batches.

Documents of a batch lie end to end in one byte array, so a word or an n-gram
of any document is a pair of offsets and every step below is a handful of numpy
calls for a whole chunk instead of a Python loop over its words.

A document is never cut, so the longest text decides what memory a task needs: some
tens of bytes for each of its bytes. Texts of 3 MB are tested; one of more than about
30 MB doesn't fit an executor of 3 GB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one chunk holds at most (a single longer document is a chunk of its own).
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte.
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUES_LOWER = BYTE_VALUES[LOWER]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words in the sense of the decontamination contract: ASCII letters, digits, and all of non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below n (kept between calls)."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection of 64-bit values."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text. offsets has one more entry than rows, from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, cut so that the texts of a chunk hold at most `limit` bytes unless it is one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = bytes_of(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def runs(member: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the maximal runs of member bytes within each document; first[d] is the index of document d's first run."""
    n = len(member)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begins = member.copy()
    begins[1:] &= ~member[:-1] | edge[1:-1]
    finishes = member.copy()
    finishes[:-1] &= ~member[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, at)


def prefix_hashes(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2^64; span_hashes() takes the hash of any span from them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans' bytes, the same wherever the span lies."""
    raw = (prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts]
    return mix(raw + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes (n - 1 fewer entries than words); rolls over documents, see whole()."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out *= _U(0xC2B2AE3D27D4EB4F)
        out += words[i : i + m]
    return mix(out)


def owners(first: np.ndarray, n: int) -> np.ndarray:
    """The document of each run, from first of runs()."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if n else np.zeros(0, np.int64)


def within(owner: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n-grams that lie in one document."""
    if len(owner) < n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(owner[n - 1 :] == owner[: len(owner) - n + 1])


def repeated(keys: np.ndarray) -> np.ndarray:
    """For each key whether an equal one is in the array."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """For each key whether an equal one comes before it."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    out = np.zeros(len(keys), bool)
    out[order[1:][ranked[1:] == ranked[:-1]]] = True
    return out


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each document's runs."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
