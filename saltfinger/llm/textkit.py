"""Vectorised helpers on whole Arrow text columns: chunks, words, rolling hashes.

Everything here works on one bounded chunk of a partition at a time; no helper
holds more than one chunk (plus one row, if that row alone is larger).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SOLID = ~_SPACE
#: Letters and digits of ASCII, and all bytes beyond it.
ALNUM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_WORD_CODE = _BYTE_CODE[_LOWER]
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept for the next chunk)."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def release() -> None:
    """Give freed memory back to the system. Python workers live on from task to
    task, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) pieces of at most ``limit`` bytes, or one row."""
    data, at = utf8(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end
    release()


def rolling(data: np.ndarray, code: np.ndarray = _BYTE_CODE) -> np.ndarray:
    """Prefix sums from which ``span_hash`` gets the hash of any byte range."""
    up, _ = powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.add.accumulate(code[data] * up, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hash of data[start:end], before ``mix``."""
    _, down = powers(len(sums))
    return (sums[end] - sums[start]) * down[start]


def words(data: np.ndarray, at: np.ndarray, solid: np.ndarray = _SOLID) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of the rows' words); words are runs of bytes
    that solid has, by default all but space and 0x09-0x0D, with A-Z lower-cased."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    solid = solid[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = mix(span_hash(rolling(data, _WORD_CODE), start, end))
    return hashes, np.searchsorted(start, at, "left")


def runs(data: np.ndarray, at: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each run of bytes that the 256-entry table solid has; runs
    end with their row."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.empty(n + 1, dtype=bool)
    inside[:n] = solid[data]
    inside[n] = False
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1]
    edge = at[(at > 0) & (at < n)]
    first[edge] = inside[edge]
    last = inside[:n] & ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray, solid: np.ndarray) -> pa.Array:
    """Arrow strings of all runs of bytes that solid has."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[solid[data]]))


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


def shingles(hashes: np.ndarray, at: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each row. A row with
    fewer words is one shingle of them all, a row without words has none."""
    total = len(hashes)
    step = np.uint64(0xD6E8FEB86659FD93)
    if total >= n:
        grams = np.zeros(total - n + 1, np.uint64)
        for j in range(n):
            grams = grams * step + hashes[j : total - n + 1 + j]
        grams = mix(grams)
    else:
        grams = np.empty(0, np.uint64)
    for first, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        count = end - first
        if count >= n:
            own = np.sort(grams[first : end - n + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own
        elif count:
            whole = np.uint64(count)
            with np.errstate(over="ignore"):
                for h in hashes[first:end]:
                    whole = whole * step + h
            yield mix(np.array([whole], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def set_key(own: np.ndarray) -> int:
    """64-bit key of a set of hashes, as a signed long."""
    with np.errstate(over="ignore"):
        total = mix(own ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(own))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)
