"""Context-triggered piecewise hashing of whole texts.

A rolling hash over the last seven bytes marks chunk ends; each chunk gives one signature character. The block
size is the power of two at which a text has at most 64 chunks, so no text is cut short. A fingerprint holds the
block size's exponent and the signatures at that, twice and four times that size; two fingerprints are compared by
edit distance (insertion and deletion cost 1, substitution 2) wherever their block sizes agree.

Defined results: a null text is an empty one; an empty text's fingerprint is "0:::"; equal texts have equal
fingerprints, and equal fingerprints have likeness 1. Rows with the same doc_id are ordered by text; a null
doc_id comes last in descending order. An empty table gives an empty result; columns beside doc_id and text are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .textops import arrow

#: Bytes of the rolling hash, chunks of a signature at most, signature characters in a row that alike texts share.
WINDOW, MOST_CHUNKS, RUN = 7, 64, 5
LEVELS = 3
_SYMBOLS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_SPREAD = np.uint32(0x9E3779B1)
_WEIGHTS = [np.uint32(pow(0x2C1B3C6D, j, 1 << 32)) for j in range(WINDOW)]


def _rolling(buf: np.ndarray) -> np.ndarray:
    """Of each position, a mixed hash of it and the six bytes before it."""
    wide = buf.astype(np.uint32) + np.uint32(1)
    r = wide.copy()
    for j in range(1, min(WINDOW, len(buf))):
        r[j:] += wide[:-j] * _WEIGHTS[j]
    r ^= r >> np.uint32(15)
    r *= _SPREAD
    r ^= r >> np.uint32(13)
    return r


def _signature(r: np.ndarray, ends: np.ndarray) -> str:
    starts = np.concatenate([[0], ends + 1])
    starts = starts[starts < len(r)]
    digest = np.add.reduceat(r, starts, dtype=np.uint32) * _SPREAD
    return _SYMBOLS[digest >> np.uint32(26)].tobytes().decode()


def fingerprint(data: bytes) -> str:
    """'<exponent>:<signature>:<at twice the block size>:<at four times>' of a whole text's UTF-8 bytes."""
    if not data:
        return "0" + ":" * LEVELS
    r = _rolling(np.frombuffer(data, np.uint8))
    k = max(0, (len(data) // MOST_CHUNKS).bit_length() - 1)
    ends = np.flatnonzero((r & np.uint32((1 << k) - 1)) == 0)
    while len(ends) + (len(ends) == 0 or ends[-1] + 1 < len(r)) > MOST_CHUNKS:
        k += 1
        ends = ends[(r[ends] & np.uint32((1 << k) - 1)) == 0]
    levels = (ends[(r[ends] & np.uint32((1 << (k + j)) - 1)) == 0] for j in range(LEVELS))
    return f"{k}:" + ":".join(_signature(r, at) for at in levels)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n = min(RUN, len(a), len(b))
    if not n or not {a[i : i + n] for i in range(len(a) - n + 1)} & {b[i : i + n] for i in range(len(b) - n + 1)}:
        return 0.0
    distance = len(a) + len(b) - 2 * common_subsequence(a, b)
    return 1.0 - distance / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1: edit-distance likeness of two fingerprints at block sizes they share; 0 if they share none."""
    if x == y:
        return 1.0
    (i, *a), (j, *b) = x.split(":"), y.split(":")
    step = int(i) - int(j)
    return max((_alike(a[n], b[n + step]) for n in range(LEVELS) if 0 <= n + step < LEVELS), default=0.0)


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one cell in order, then the first row of the next cell, which only serves as successor."""
    held = None
    for batch in batches:
        out = []
        for pid, extra, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("pid", "extra", "doc_id", "text")), strict=True):
            if held is not None and held[0] == pid:
                prior, mark = held[2], held[3]
                own = mark if mark is not None else fingerprint(prior.encode())
                following = fingerprint(text.encode())
                half = len(prior) // 2
                edited = (prior[: len(prior) - half] + text[:half]).encode()
                changed = fingerprint(edited)
                out.append((held[1], len(prior), hashlib.sha256(edited).hexdigest(), own, changed, likeness(own, changed), likeness(own, following)))
                held = None if extra else (pid, doc_id, text, following)
            elif not extra:
                held = (pid, doc_id, text, None)
        if out:
            names = [f.split()[0] for f in _RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and its likeness to the next document, descending doc_id.

    The texts are shuffled once, into cells of consecutive doc_id. A cell also gets the first row of the following
    cell (one row per cell), so that no row needs a global order in one task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(shuffle_partitions(spark), rows.rdd.getNumPartitions())
    bounds = np.unique(np.array(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)), dtype=np.int64))
    last = len(bounds) + 1  # cell of a null doc_id

    @F.pandas_udf("int")
    def cell(ids: pd.Series) -> pd.Series:
        return pd.Series((len(bounds) - np.searchsorted(bounds, ids, side="right")).astype(np.int32))

    placed = rows.withColumn("pid", F.when(F.col("doc_id").isNull(), last).otherwise(cell(F.coalesce("doc_id", F.lit(0)))))
    heads = sorted((r["pid"], r["head"]) for r in placed.select("pid", "doc_id").groupBy("pid").agg(F.max("doc_id").alias("head")).collect())
    if not heads:
        return spark.createDataFrame([], _RESULT)
    follow = [(heads[(i + 1) % len(heads)][1], heads[i][0]) for i in range(len(heads))]
    to = spark.createDataFrame(follow, "first_id long, dest int")
    extra = rows.join(F.broadcast(to), F.col("doc_id").eqNullSafe(F.col("first_id"))).select(F.col("dest").alias("pid"), F.lit(True).alias("extra"), "doc_id", "text")
    dealt = placed.select("pid", F.lit(False).alias("extra"), "doc_id", "text").unionByName(extra).repartitionById(last + 1, "pid")
    return dealt.sortWithinPartitions("pid", "extra", F.desc_nulls_last("doc_id"), "text").transform(arrow(_chain, _RESULT))
