"""k-mers of strings: one for each position, cut at the string's end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..arrow_text import column_bytes, strings

#: Characters handled at once.
STEP = 1 << 18


def optimal_k(requested: int, bits: int, longest: int, word: int = 63) -> int:
    """The requested length (or, for 0, the longest that fits a word), at most the text's length."""
    most = word // bits
    return max(1, min(requested or most, most, longest))


def _windows(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Row, position and k-mer of all characters, some at a time: stretches of the column's own bytes."""
    buf, offsets = column_bytes(column)
    starts = np.flatnonzero((buf & 0xC0) != 0x80)
    if not len(starts):
        return
    first = np.searchsorted(starts, offsets)  # of each row its first character
    bounds = np.append(starts, len(buf))
    for at in range(0, len(starts), STEP):
        c = np.arange(at, min(at + STEP, len(starts)))
        row = np.searchsorted(first, c, side="right") - 1
        end = bounds[np.minimum(c + k, first[row + 1])]
        yield row, c - first[row], strings(buf, starts[c], end - starts[c])


def kmers(texts: DataFrame, k: int) -> DataFrame:
    """str_id, pos, kmer of strings (str_id, text); k-mers at a string's end are shorter."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, pos, found in _windows(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(pos), found], names=["str_id", "pos", "kmer"])

    return texts.select(F.col("str_id").cast("long").alias("str_id"), "text").mapInArrow(work, "str_id long, pos long, kmer string")


def packed_kmers(strings: DataFrame, alphabet: DataFrame, k: int, bits: int) -> DataFrame:
    """str_id, pos, packed: codes of k symbols from the left, zero beyond the string's end."""
    if k * bits > 63:
        raise ValueError("k symbols don't fit 63 bits")
    rows = alphabet.collect()  # at most the code points of Unicode
    code = np.zeros(0x110000, np.int64)
    code[[ord(r["ch"]) for r in rows]] = [r["code"] for r in rows]
    shared = strings.sparkSession.sparkContext.broadcast(code)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = shared.value[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.int32)]
                for at in range(0, len(own), STEP):
                    part = np.concatenate([own[at : at + STEP + k - 1], np.zeros(k, np.int64)])
                    n = min(STEP, len(own) - at)
                    word = np.zeros(n, np.int64)
                    for j in range(k):
                        word = word << bits | part[j : j + n]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i)), pa.array(np.arange(at, at + n)), pa.array(word)], names=["str_id", "pos", "packed"])

    return strings.select(F.col("str_id").cast("long").alias("str_id"), "text").mapInArrow(work, "str_id long, pos long, packed long")


def decode_kmers(packed: DataFrame, alphabet: DataFrame, k: int, bits: int) -> DataFrame:
    """packed with kmer; symbols beyond the end are shown as '0'."""
    rows = alphabet.collect()
    names = dict([(0, "0"), *((r["code"], r["ch"]) for r in rows)])
    shared, schema = packed.sparkSession.sparkContext.broadcast(names), T.StructType([*packed.schema.fields, T.StructField("kmer", T.StringType())])
    at = packed.columns.index("packed")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = batch.column(at).to_numpy()
            symbols = [[shared.value[c] for c in (word >> bits * (k - 1 - i) & (1 << bits) - 1).tolist()] for i in range(k)]
            found = pa.array(["".join(x) for x in zip(*symbols, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "kmer"])

    return packed.mapInArrow(work, schema)


def kmer_histogram(texts: DataFrame, k: int) -> DataFrame:
    """kmer and n over all positions; counted by batches before the exchange."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, found in _windows(batch.column(0), k):
                counts = found.value_counts()
                yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["kmer", "n"])

    return texts.select("text").mapInArrow(work, "kmer string, n long").groupBy("kmer").agg(F.sum("n").alias("n"))
