"""Vectorised text kernels over Arrow string buffers: words, word hashes, shingles. No Python object per word."""

from __future__ import annotations

import ctypes
import functools
import inspect

import numpy as np
import pyarrow as pa

U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)


def _trim() -> None:
    """Hands memory that is free back to the system: a worker lives on through later tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(f):
    """A function of a group, or a generator of a task, that keeps no free memory behind it."""
    if inspect.isgeneratorfunction(f):

        @functools.wraps(f)
        def each(batches):
            yield from f(batches)
            _trim()

        return each

    def then(out):
        _trim()
        return out

    # Spark counts the arguments
    if len(inspect.signature(f).parameters) == 1:
        return lambda table: then(f(table))
    return lambda table, other: then(f(table, other))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over 64 bits (the splitmix64 constants)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]

#: Bytes of words: all but space and 0x09-0x0D.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words: 0-9, letters of both cases (for case-folded texts) and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_CACHE: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _CACHE or len(_CACHE[0]) < n:
        size = max(n, 1 << 20)
        factors = [np.full(size, r, U64) for r in (_R, _R_INV)]
        for f in factors:
            f[0] = 1
        _CACHE[:] = [np.cumprod(f, dtype=U64) for f in factors]
    return _CACHE[0][:n], _CACHE[1][:n]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as uint8, offsets of length rows + 1) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def segments(offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges [a, b) whose bytes stay under ``most`` where a single row allows it."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row with the total at the end) of the maximal runs of word bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = classes[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = inside[0], False
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begin = inside & ~(np.concatenate(([False], inside[:-1])) & ~cut[:-1])
    end = inside & ~(np.concatenate((inside[1:], [False])) & ~cut[1:])
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word; A-Z counts as a-z if ``lower``."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def doc_words(column, classes: np.ndarray = NON_SPACE, lower: bool = True):
    """For ranges of rows: (first row, word hashes, first word of each row in the range with the total at the end)."""
    data, offsets = text_buffers(column)
    for a, b in segments(offsets):
        part = data[offsets[a] : offsets[b]]
        starts, ends, first = word_spans(part, offsets[a : b + 1] - offsets[a], classes)
        yield a, word_hashes(part, starts, ends, lower), first


def ngrams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows inside each row, and the first window of each row with the total at the end.

    A row with fewer words, but one at least, has one window: its whole sequence."""
    counts = np.diff(first)
    windows = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(windows)))
    rows = np.repeat(np.arange(len(counts)), windows)
    begin = first[:-1][rows] + np.arange(at[-1]) - at[:-1][rows]
    length = np.minimum(counts[rows], n)
    total = np.zeros(len(begin), U64)
    for k in range(n):
        here = length > k
        total[here] = total[here] * U64(0xD6E8FEB86659FD93) + words[begin[here] + k]
    return mix(total + length.astype(U64) * U64(0xA0761D6478BD642F)), at


def pack(values: np.ndarray) -> bytes:
    """Whole numbers that aren't negative, by byte planes behind a byte with the planes' number: none for bytes that are zero
    throughout, and the shuffle's compression sees the runs of zeros in the others. Unsigned 64-bit numbers are taken as sorted."""
    a = np.ascontiguousarray(values)
    if not len(a):
        return b""
    if a.dtype == U64:
        a = np.diff(a, prepend=U64(0))
    planes = max(1, (int(a.max()).bit_length() + 7) // 8)
    return bytes([planes]) + np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize)[:, :planes].T).tobytes()


def unpack(blob: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    if not blob:
        return np.zeros(0, dtype)
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(blob[0], -1)
    a = np.zeros((planes.shape[1], dtype.itemsize), np.uint8)
    a[:, : blob[0]] = planes.T
    a = a.view(dtype).ravel()
    return np.cumsum(a, dtype=U64) if dtype == U64 else a


def bundle(blobs: list[bytes]) -> bytes:
    return b"".join(len(b).to_bytes(8, "little") + b for b in blobs)


def unbundle(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        size = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + size])
        at += 8 + size
    return out
