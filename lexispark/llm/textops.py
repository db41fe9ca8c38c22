"""Vectorised text primitives shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..arrow_text import column_bytes, picked

__all__ = ["BLOCK", "arrow", "column_bytes", "mix64", "picked", "powers", "slices", "span_hashes", "word_hashes", "word_spans"]

#: Bytes handled at once; bounds the temporary arrays, whatever the length of a text.
BLOCK = 1 << 20
_MULTIPLIER = 0x5851F42D4C957F2D
_POWERS: dict[str, np.ndarray] = {}
#: Bytes above which a stretch is hashed on its own.
LONG = 1024
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


#: Rows of an Arrow batch where the session has Spark's default: texts are long, and a batch is held several times.
BATCH_ROWS = 2000
_DEFAULT_ROWS = "10000"


def arrow(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> Callable[[DataFrame], DataFrame]:
    """For DataFrame.transform: mapInArrow with small batches, whose workers give free memory back after each task."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    def apply(df: DataFrame) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if df.sparkSession.conf.get(key) == _DEFAULT_ROWS:
            df.sparkSession.conf.set(key, BATCH_ROWS)
        return df.mapInArrow(lean, schema)

    return apply


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) over an array, into a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hashes' multiplier, and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
            a = np.full(n, base, dtype=np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches of data, none of them empty.

    Eight bytes at a time go through a finaliser, so that no sum of powers is left that patterned texts could cancel;
    a stretch above LONG bytes is hashed as a whole.
    """
    out = mix64(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(_MULTIPLIER))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live, done = np.flatnonzero(size <= LONG), 0
    while len(live):
        rest = size[live] - done
        load = eight[start[live] + done]
        load &= _MASKS[np.minimum(rest, 8)]
        out[live] = mix64(out[live] ^ load)
        live = live[rest > 8]
        done += 8
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + size[i]], digest_size=8).digest(), "little")
    return out


def _block_words(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of one block; cuts are offsets at which a row begins."""
    gap = (buf == 0x20) | ((buf >= 0x09) & (buf <= 0x0D))
    solid = ~gap
    first = solid.copy()
    first[1:] &= gap[:-1]
    last = solid.copy()
    last[:-1] &= gap[1:]
    inner = cuts[(cuts > 0) & (cuts < len(buf))]
    first[inner] |= solid[inner]
    last[inner - 1] |= solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    low = buf + (((buf >= 65) & (buf <= 90)).astype(np.uint8) << 5)
    return span_hashes(low, starts, ends - starts), starts, ends


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of all rows, A-Z lower-cased, their first bytes and the bytes
    after their last, and n + 1 row offsets into them.

    Works in blocks that end between words, so that the temporary arrays stay small.
    """
    found, lo, n = [], 0, len(buf)
    while lo < n:
        hi = min(n, lo + BLOCK)
        while hi < n:  # a block ends at a row's start or at white space
            nearby = buf[hi : hi + 4096]
            stop = np.flatnonzero((nearby == 0x20) | ((nearby >= 0x09) & (nearby <= 0x0D)))
            row = offsets[np.searchsorted(offsets, hi)]
            if row < hi + len(nearby) and (not len(stop) or row <= hi + stop[0]):
                hi = int(row)
                break
            if len(stop):
                hi += int(stop[0])
                break
            hi += len(nearby)
        a, b = np.searchsorted(offsets, lo), np.searchsorted(offsets, hi)
        h, start, end = _block_words(buf[lo:hi], offsets[a:b] - lo)
        found.append((h, start + lo, end + lo))
        lo = hi
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    h, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
    return h, start, end, np.searchsorted(start, offsets)


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and n + 1 row offsets into them."""
    h, _, _, rows = word_spans(buf, offsets)
    return h, rows


def slices(offsets: np.ndarray, limit: int = 4 * BLOCK):
    """Row ranges [a, b) of at most limit bytes each, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b
        a = b
