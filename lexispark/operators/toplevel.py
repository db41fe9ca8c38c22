"""Top-level indexes and partitioning: sampled common prefixes, weighted bisection, load imbalance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .ansv import ansv
from .ranking import ranked


def sample_lcp(lcp: DataFrame, most: int) -> DataFrame:
    """idx and lcp of the indexes whose parent interval has more than `most` suffixes, and of all zeros."""
    n = lcp.count()
    values = settle(lcp.select(F.col("rank").alias("idx"), F.col("lcp").alias("v")), "lcp")
    left = ansv(values, "left", "nearest_sm", 0).select("idx", F.col("match").alias("a"))
    right = ansv(values, "right", "nearest_sm", n).select("idx", F.col("match").alias("z"))
    rows = values.join(left, "idx").join(right, "idx")
    return rows.where((F.col("v") == 0) | (F.col("z") - F.col("a") > most)).select("idx", F.col("v").alias("lcp"))


def _cuts(sums: DataFrame, ranges: list[tuple[int, int, int]]) -> dict[int, tuple[int, int]]:
    """Of each range (low, high, goal) of bins, by its number: the bin where the running sum comes closest to the goal, the
    larger sum on a tie, and that sum. One row of each range and batch is aggregated; sums (idx, s) stay where they are."""
    low, high, goal = (np.array(c, np.int64) for c in zip(*ranges, strict=True))
    order = np.argsort(low, kind="stable")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = np.searchsorted(low[order], idx, side="right") - 1
            own = order[np.maximum(at, 0)]
            use = np.flatnonzero((at >= 0) & (idx < high[own]))
            own, idx, s = own[use], idx[use], s[use]
            away = np.abs(s - goal[own])
            by = np.lexsort((idx, -s, away, own))
            best = by[np.flatnonzero(np.concatenate([[True], own[by][1:] != own[by][:-1]]))] if len(by) else by
            yield pa.RecordBatch.from_arrays([pa.array(x[best]) for x in (own, away, -s, idx)], names=["range", "away", "less", "idx"])

    found = sums.select("idx", "s").mapInArrow(work, "range long, away long, less long, idx long")
    rows = found.groupBy("range").agg(F.min(F.struct("away", "less", "idx")).alias("x")).collect()
    return {r["range"]: (r["x"]["idx"], -r["x"]["less"]) for r in rows}


def partition_bins(bins: DataFrame, parts: int) -> DataFrame:
    """part, first_bin (its place in order) and rows for bins (bin, n), however many."""
    return partitions(bins, [parts])[0]


def partitions(bins: DataFrame, numbers: list[int]) -> list[DataFrame]:
    """partition_bins for several numbers of parts, which share the running sums and the cuts they have in common.

    A range of bins is cut where its running sum comes closest to its share, the larger sum on a tie; the left half gets
    the odd part. Empty ranges leave their parts empty. Each level of halving passes over the running sums once; only the
    cuts reach the driver.
    """
    sums = settle(ranked(bins.select("bin", "n"), ["bin"], add="n").select("idx", (F.col("before") + F.col("n")).alias("s")), "sums")
    n, total = sums.agg(F.count("*"), F.coalesce(F.max("s"), F.lit(0))).first()
    known: dict[tuple[int, int, int], tuple[int, int]] = {}
    return [_partition(sums, n, total, parts, known) for parts in numbers]


def _partition(sums: DataFrame, n: int, total: int, parts: int, known: dict[tuple[int, int, int], tuple[int, int]]) -> DataFrame:
    starts = {0: (0, 0)}  # of a part its first bin and the sum before it
    level = [(0, n, 0, total, 0, parts)]  # first and last bin, sums before and behind, first part, parts
    while level := [x for x in level if x[5] > 1]:
        asked = [(low, high, before + (after - before) * ((k + 1) // 2) // k) for low, high, before, after, _, k in level]
        if fresh := [x for x in asked if x[0] < x[1] and x not in known]:
            found = _cuts(sums, fresh)
            known.update((x, found[i]) for i, x in enumerate(fresh))
        halves = []
        for i, (low, high, before, after, part, k) in enumerate(level):
            left = (k + 1) // 2
            at = known.get(asked[i])
            cut, s = (at[0] + 1, at[1]) if at else (low, before)
            starts[part + left] = cut, s
            halves += [(low, cut, before, s, part, left), (cut, high, s, after, part + left, k - left)]
        level = halves
    own = [starts[p] for p in range(parts)] + [(n, total)]
    return sums.sparkSession.createDataFrame([(p, own[p][0], max(0, own[p + 1][1] - own[p][1])) for p in range(parts)], "part long, first_bin long, rows long")


def imbalance(parts: DataFrame) -> DataFrame:
    """parts, most, least and percent by which the largest part exceeds the mean."""
    found = parts.agg(F.count("*").alias("parts"), F.max("rows").alias("most"), F.min("rows").alias("least"), F.sum("rows").alias("total"))
    mean = F.floor(F.col("total") / F.col("parts"))
    return found.select("parts", "most", "least", F.try_divide((F.col("most") - mean) * 100.0, mean).alias("percent"))
