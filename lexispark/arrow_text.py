"""Byte views of Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def picked(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of data, none of them empty, one after the other."""
    if not len(size):
        return data[:0]
    step = np.ones(int(size.sum()), np.int64)
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    step[at] = begin - np.concatenate([[0], (begin + size - 1)[:-1]])
    return data[np.cumsum(step)]


def strings(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """The stretches of data as a string column."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.tobytes()), pa.py_buffer(picked(data, begin, size).tobytes()))
