"""Array kernels over the bytes of Arrow string columns: word and shingle hashes.

All of them work on whole texts; a batch is taken in slices of whole documents
so that scratch arrays stay small, whatever the batch size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
SLICE_BYTES = 400_000
_C1, _C2, _C3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
_P = U(0x5851F42D4C957F2D)


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; the memory of a batch goes back to the system before the next one comes."""
    for batch in batches:
        yield batch
        del batch
        trim()


def trim() -> None:
    """Give memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x + _C3
    x = (x ^ (x >> U(30))) * _C1
    x = (x ^ (x >> U(27))) * _C2
    return x ^ (x >> U(31))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of whole rows with about ``most`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


#: A-Z folded to a-z
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: everything but ASCII letters, digits and bytes of longer characters
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        inv = U(pow(int(_P), -1, 1 << 64))
        up, down = np.full(n, _P, U), np.full(n, inv, U)
        up[:1] = down[:1] = 1
        _POWERS[:] = [np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)]
    return _POWERS[0], _POWERS[1]


#: the low n bytes of a number
LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
#: words of more bytes are hashed one by one
LONG = 64


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros beyond the end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span: eight bytes at a step, mixed into the hash of what came before."""
    eight, size = loads(data), end - start
    h = mix(size.astype(U))
    todo, at = np.flatnonzero(size <= LONG), 0
    while len(todo):
        h[todo] = mix(h[todo] ^ (eight[start[todo] + at] & LOW[np.minimum(size[todo] - at, 8)]))
        at += 8
        todo = todo[size[todo] > at]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]])
    return h


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, ...]:
    """(hash, row, start, end) of each word, A-Z folded to a-z; start and end in bytes of ``data``."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sep = separators[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = sep[:-1], sep[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before[edge], after[edge - 1] = True, True
    start, end = np.flatnonzero(before & ~sep), np.flatnonzero(after & ~sep) + 1
    return span_hashes(FOLD[data], start, end), np.searchsorted(offsets, start, "right") - 1, start, end


_ODD = mix(np.arange(1, 65, dtype=U)) | U(1)


def shingles(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of ``k`` words within a row, ascending by row."""
    if len(h) < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    n = len(h) - k + 1
    out = np.zeros(n, U)
    for j in range(k):
        out += h[j : j + n] * _ODD[j]
    whole = row[:n] == row[k - 1 :]
    return mix(out[whole]), row[:n][whole]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; fewer than ``k`` words make one
    shingle of the whole sequence, no words none."""
    out: list[np.ndarray] = []
    for i, j in slices(offsets):
        own = offsets[i : j + 1] - offsets[i]
        h, row, _, _ = words(data[offsets[i] : offsets[j]], own)
        count = np.bincount(row, minlength=j - i)
        first = np.concatenate([[0], np.cumsum(count)])
        s, at = shingles(h, row, k)
        cut = np.searchsorted(at, np.arange(j - i + 1))
        for r in range(j - i):
            if count[r] >= k:
                out.append(np.unique(s[cut[r] : cut[r + 1]]))
            elif count[r]:
                w = h[first[r] : first[r + 1]]
                out.append(mix((w * _ODD[: len(w)]).sum(dtype=U, keepdims=True) + count[r : r + 1].astype(U) * _C2))
            else:
                out.append(np.zeros(0, U))
    return out
