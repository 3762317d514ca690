"""Byte-level text helpers that run inside Arrow tasks.

A text column arrives as one UTF-8 buffer plus offsets; words, word hashes and
k-word hashes are numpy expressions over that buffer, so no Python object is
made per word.  Hashes are 64-bit and identical on every executor.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


@functools.lru_cache(maxsize=4)
def byte_codes(lower: bool = False) -> np.ndarray:
    """An odd 64-bit code for each byte value; with ``lower`` A-Z share the codes of a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


_POWERS: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64 for positions below ``n``."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def utf8_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole rows of about ``limit`` bytes.

    Yields ``(first row, end row, bytes, offsets)``; a null row has no bytes.
    A row above the limit forms a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + n + 1]
    if column.null_count:  # a null slot may span bytes
        valid = np.asarray(column.is_valid())
        column = column.fill_null("")
        _, off, data = column.buffers()
        offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + n + 1]
        assert (np.diff(offsets)[~valid] == 0).all()
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


@functools.lru_cache(maxsize=4)
def word_table(kind: str) -> np.ndarray:
    """Which bytes belong to a word: ``space`` cuts at ASCII white space only,
    ``alnum`` keeps 0-9, letters and all bytes above ASCII."""
    t = np.ones(256, bool)
    if kind == "space":
        t[[0x20, 9, 10, 11, 12, 13]] = False
    else:
        t[:128] = False
        t[48:58] = t[65:91] = t[97:123] = True
    return t


def words(raw: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; a word never crosses a row."""
    inside = word_table(kind)[raw]
    n = len(raw)
    if n == 0:
        e = np.empty(0, np.int64)
        return e, e, e
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    left = np.empty(n, bool)
    left[0] = True
    np.logical_not(inside[:-1], out=left[1:])
    starts = np.flatnonzero(inside & (left | cut[:n]))
    right = np.empty(n, bool)
    right[-1] = True
    np.logical_not(inside[1:], out=right[:-1])
    ends = np.flatnonzero(inside & (right | cut[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each byte span (optionally with A-Z folded to a-z)."""
    p, inv = _powers(len(raw) + 1)
    c = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(byte_codes(lower)[raw] * p[:len(raw)], out=c[1:])
    return mix((c[ends] - c[starts]) * inv[starts])


@functools.lru_cache(maxsize=8)
def _gram_codes(k: int) -> np.ndarray:
    return mix(np.arange(1000 * k, 1000 * k + k, dtype=np.uint64)) | np.uint64(1)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes (``len - k + 1`` values, rows not regarded)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i, c in enumerate(_gram_codes(k)):
        h += hashes[i:i + n] * c
    return mix(h)


def row_bounds(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Offsets of each row in a sorted row-number array (``n_rows + 1`` values)."""
    return np.searchsorted(rows, np.arange(n_rows + 1))


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values in linear time."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    pad = (-len(values)) % w
    top = np.iinfo(values.dtype).max
    v = np.concatenate([values, np.full(pad, top, values.dtype)]).reshape(-1, w)
    head = np.minimum.accumulate(v, axis=1).ravel()
    tail = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1:w - 1 + n])


def signed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return h.view(np.int64)
