"""All nearest smaller values: nearest strictly smaller, nearest smaller or equal, furthest equal; left and right.

Rows are dealt in blocks of consecutive indexes. A task answers inside its block on a tree of minima, for all rows at
once, and finds, for what is left, the nearest block with a fitting minimum on a tree over the blocks; there is one minimum
for each block, and blocks are as large as it takes to keep at most MOST_BLOCKS of them, which bounds what is broadcast.
Those questions go, packed, to the values that their block has nothing smaller after; a block that is asked by many others
is copied, a copy for every ASKED questions. The furthest equal value follows from the nearest: it is the first member of
the values that agree in value and in their nearest smaller one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import exchanged, settle, shuffle_partitions

BLOCK, MOST_BLOCKS, ASKED = 1 << 16, 1 << 22, 1 << 22
KINDS = ("nearest_sm", "nearest_eq", "furthest_eq")
_ROWS = "idx long, v long, j long, target long, source long, places binary, values binary"


def minima_tree(values: np.ndarray) -> np.ndarray:
    """Minima over powers of two of consecutive values: node i has children 2 i and 2 i + 1; leaves are the second half."""
    width = 1 << max(0, int(len(values) - 1).bit_length())
    tree = np.full(2 * width, np.iinfo(np.int64).max, np.int64)
    tree[width : width + len(values)] = values
    while width > 1:
        tree[width // 2 : width] = np.minimum(tree[width : 2 * width : 2], tree[width + 1 : 2 * width : 2])
        width //= 2
    return tree


def nearest_left(tree: np.ndarray, at: np.ndarray, v: np.ndarray, equal: bool) -> np.ndarray:
    """For each index in at the nearest one before it with a value below v (or equal to it); -1: none."""
    width = len(tree) // 2
    fits = np.less_equal if equal else np.less
    node, live = at + width, np.arange(len(at))
    found = np.full(len(at), -1, np.int64)
    while len(live):  # up, until the tree to the left holds a fitting value
        own = node[live]
        hit = ((own & 1) == 1) & (own > 1) & fits(tree[own - 1], v[live])
        found[live[hit]] = own[hit] - 1
        node[live] = own >> 1
        live = live[~hit & (own > 1)]
    live = np.flatnonzero((found >= 0) & (found < width))
    while len(live):  # down, to the right wherever a value fits there
        right = 2 * found[live] + 1
        found[live] = right - ~fits(tree[right], v[live])
        live = live[found[live] < width]
    return np.where(found >= 0, found - width, -1)


def _nearest(values: DataFrame, equal: bool, size: int, minima: np.ndarray) -> DataFrame:
    """idx, v and j: the nearest index to the left with a value below v (or equal to it); null if there is none."""
    spark = values.sparkSession
    shared = spark.sparkContext.broadcast(minima_tree(minima))
    schema = [(x.split()[0], {"long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in _ROWS.split(", ")]

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k, mask=columns.get(f"no_{c}")) if c in columns else pa.nulls(n, k) for c, k in schema], names=[c for c, _ in schema])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []

        def closed() -> Iterator[pa.RecordBatch]:
            v = np.concatenate(parts)
            idx = held * size + np.arange(len(v))
            j = nearest_left(minima_tree(v), np.arange(len(v)), v, equal)
            open_ = np.flatnonzero(j < 0)
            to = nearest_left(shared.value, np.full(len(open_), held), v[open_], equal)
            answered = np.ones(len(v), bool)
            answered[open_[to >= 0]] = False
            yield batch_of(int(answered.sum()), idx=idx[answered], v=v[answered], j=held * size + j[answered], no_j=j[answered] < 0)
            open_, to = open_[to >= 0], to[to >= 0]
            order = np.argsort(to, kind="stable")
            open_, to = open_[order], to[order]
            cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
            asked = [(int(to[a]), held, idx[open_[a:z]].tobytes(), v[open_[a:z]].tobytes()) for a, z in zip(cuts, np.append(cuts[1:], len(to))[: len(cuts)], strict=True)]
            after = np.append(np.minimum.accumulate(v[::-1])[::-1][1:], np.iinfo(np.int64).max)
            chain = np.flatnonzero(v < after) if v[-1] < after[-1] else np.append(np.flatnonzero(v < after), len(v) - 1)
            asked.append((held, None, idx[chain].tobytes(), v[chain].tobytes()))
            target, source, places, found = zip(*asked, strict=True)
            yield batch_of(len(asked), target=list(target), source=list(source), places=list(places), values=list(found))

        for batch in batches:
            block, v = batch.column("block").to_numpy(), batch.column("v").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]]) if len(block) else np.zeros(1, np.int64)
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if block[a] != held and parts:
                    yield from closed()
                    parts = []
                held = int(block[a])
                parts.append(v[a:z])
        if parts:
            yield from closed()

    dealt = values.select(F.floor(F.col("idx") / size).cast("long").alias("block"), "idx", "v").repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block", "idx").select("block", "v")
    rows = settle(dealt.mapInArrow(work, _ROWS), "nearest")
    answered = rows.where("target IS NULL").select("idx", "v", "j")
    asked = rows.where("source IS NOT NULL").select("target", "source", "places", "values")
    copies = asked.groupBy("target").agg(F.ceil(F.sum(F.length("places")) / (8 * ASKED)).alias("copies"))
    chains = rows.where("target IS NOT NULL AND source IS NULL").select("target", F.col("places").alias("chain"), F.col("values").alias("low")).join(exchanged(copies), "target")
    copied = chains.withColumn("salt", F.explode(F.expr("sequence(0L, copies - 1)"))).drop("copies")
    salted = asked.join(exchanged(copies), "target").withColumn("salt", F.pmod("source", "copies")).drop("copies")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, v, chain, low in zip(*(batch.column(c).to_pylist() for c in ("places", "values", "chain", "low")), strict=True):
                places, v, chain, low = (np.frombuffer(x, np.int64) for x in (places, v, chain, low))
                at = np.searchsorted(low, v, side="right" if equal else "left") - 1  # a chain's values rise
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(v), pa.array(chain[at])], names=["idx", "v", "j"])

    met = salted.join(exchanged(copied), ["target", "salt"]).select("places", "values", "chain", "low")
    return answered.unionByName(met.mapInArrow(look, "idx long, v long, j long"))


def ansv(values: DataFrame, side: str, kind: str, default: int, block: int = BLOCK) -> DataFrame:
    """idx, v and match of every row of values (idx 0..n-1, v); match is default where no value fits."""
    if kind not in KINDS or side not in ("left", "right"):
        raise ValueError(f"{side} {kind}")
    n = values.count()
    if side == "right":
        mirrored = values.select((F.lit(n - 1) - F.col("idx")).alias("idx"), "v")
        found = ansv(mirrored, "left", kind, -1, block)
        return found.select((F.lit(n - 1) - F.col("idx")).alias("idx"), "v", F.when(F.col("match") < 0, default).otherwise(F.lit(n - 1) - F.col("match")).cast("long").alias("match"))
    size = max(block, -(-n // MOST_BLOCKS))
    rows = values.select(F.col("idx").cast("long").alias("idx"), F.col("v").cast("long").alias("v"))
    minima = rows.groupBy(F.floor(F.col("idx") / size).alias("b")).agg(F.min("v").alias("m")).toArrow()
    low = minima.column("m").to_numpy()[np.argsort(minima.column("b").to_numpy())]
    found = _nearest(rows, kind != "nearest_sm", size, low)
    if kind == "furthest_eq":
        smaller = settle(_nearest(rows, False, size, low).select(F.col("idx").alias("j"), F.col("v").alias("u"), F.coalesce("j", F.lit(-1).cast("long")).alias("s")), "smaller")
        first = smaller.groupBy("u", "s").agg(F.min("j").alias("first"))
        named = smaller.join(exchanged(first), ["u", "s"]).select("j", "first")
        found = found.join(exchanged(named), "j", "left").select("idx", "v", F.col("first").alias("j"))
    return found.select("idx", "v", F.coalesce("j", F.lit(default).cast("long")).alias("match"))
