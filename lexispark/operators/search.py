"""Search in a suffix array: many patterns at once, FAN probes of each range in a round.

The array lies in blocks of consecutive ranks (the places of their suffixes, packed), the text in blocks of consecutive
places. A probe visits the block of its rank, then that of its suffix, where it is compared; a pattern that reaches
beyond a block goes on to the next one. Only probes move, so a round costs as much as the open patterns, not the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle, shuffle_partitions
from . import blocks as B
from .blocks import meet, packed, unpacked

#: Probes of a range in each round.
FAN = 32
ORDER = "block long, places binary"


def order_blocks(text: B.Text, ranks: B.Table) -> B.Table:
    """Rows ORDER: the suffix array in blocks of consecutive ranks."""
    size, n = text.size, text.n

    def send(row: dict) -> list[tuple]:
        rank = unpacked(row["ranks"])
        order = np.argsort(rank)
        cuts = np.searchsorted(rank[order], np.arange(0, n + size, size))
        return [(to, (rank[own] - to * size).astype(np.int32), row["block"] * size + own) for to in np.flatnonzero(np.diff(cuts)).tolist() for own in (order[cuts[to] : cuts[to + 1]],)]

    def gather(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        rank, place = (np.concatenate([unpacked(r[c], k) for r in rows]) for c, k in (("ranks", np.int32), ("places", np.int64)))
        out = np.empty(len(place), np.int64)
        out[rank] = place
        return packed(ORDER, [(rows[0]["block"], out)])

    schema = "block long, ranks binary, places binary"
    sent = ranks.rows().select("block", "ranks").mapInArrow(B.by_block(send, schema), schema)
    return B.Table(text.spark, ORDER).append(sent.repartition(shuffle_partitions(text.spark), "block").groupBy("block").applyInArrow(gather, ORDER))


_PROBE = "block long, pattern_id long, side int, rank long, pattern string, place long, done long, sign int"


def _compared(probes: DataFrame, text: B.Text, order: B.Table, longest: int) -> DataFrame:
    """probes (pattern_id, side, rank, pattern) with sign: below 0 where the suffix of the rank is smaller than the pattern,
    0 where it starts with it, above 0 where it is larger."""
    size, names = text.size, B.names(_PROBE)

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        if not n:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        row = right.to_pylist()[0]
        at = unpacked(row["places"])[left.column("rank").to_numpy() - row["block"] * size]
        return pa.table([pa.array(at // size), *(left.column(c) for c in ("pattern_id", "side", "rank", "pattern")), pa.array(at), pa.array(np.zeros(n, np.int64)), pa.nulls(n, pa.int32())], names=names).cast(pa.schema(zip(names, kinds, strict=True)))

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32()]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        row = right.to_pylist()[0]
        codes, ends = unpacked(row["codes"], np.int32), unpacked(row["ends"])
        first = row["block"] * size
        at = left.column("place").to_numpy() + left.column("done").to_numpy()
        end = ends[B.string_of(at, ends)]
        blocks, dones, signs = [], [], []
        for x, z, done, pattern in zip(at.tolist(), end.tolist(), left.column("done").to_pylist(), left.column("pattern").to_pylist(), strict=True):
            want = np.frombuffer(pattern[done:].encode("utf-32-le", "surrogatepass"), np.int32)
            here = codes[x - first : min(z - first, x - first + len(want))]
            m = len(here)
            differs = np.flatnonzero(here != want[:m])
            if len(differs):
                sign = -1 if here[differs[0]] < want[differs[0]] else 1
            elif m == len(want):
                sign = 0
            else:
                sign = -1 if x + m == z else None  # the suffix ends, or goes on in the next block
            blocks.append((x + m) // size)
            dones.append(done + m)
            signs.append(sign)
        own = [left.column(c) for c in ("pattern_id", "side", "rank", "pattern", "place")]
        return pa.table([pa.array(blocks, pa.int64()), *own, pa.array(dones, pa.int64()), pa.array(signs, pa.int32())], names=names).cast(pa.schema(zip(names, kinds, strict=True)))

    dealt = probes.select(F.floor(F.col("rank") / size).cast("long").alias("block"), "pattern_id", "side", "rank", "pattern")
    here = meet(dealt, order.rows(), place, _PROBE)
    texts = text.table.rows().select("block", "codes", "ends")
    step = meet(here, texts, compare, _PROBE)
    if longest <= B.HALO:
        return step
    step = settle(step, "compared")
    found = step.where("sign IS NOT NULL")
    while not step.where("sign IS NULL").isEmpty():
        step = settle(meet(step.where("sign IS NULL"), texts, compare, _PROBE), "compared")
        found = found.unionByName(step.where("sign IS NOT NULL"))
    return found


def search(text: B.Text, order: B.Table, ranges: DataFrame, fan: int | None = None) -> DataFrame:
    """pattern_id, l, r: of ranges (pattern_id, pattern, l, r) the part whose suffixes start with the pattern; where there
    is none, l = r is the rank that the pattern would have in its range."""
    rows = settle(ranges.select("pattern_id", "pattern", F.col("l").cast("long").alias("lo"), F.col("r").cast("long").alias("hi")), "ranges")
    longest = rows.agg(F.max(F.length("pattern"))).first()[0] or 0
    patterns = rows.select("pattern_id", "pattern")
    open_ = rows.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).select("pattern_id", "side", "lo", "hi")
    closed = open_.where("lo >= hi")
    open_ = settle(open_.where("lo < hi"), "open")
    while not open_.isEmpty():
        probes = open_.withColumn("rank", F.explode(F.expr(f"sequence(lo, hi - 1, CAST(ceil((hi - lo) / {fan or FAN}) AS BIGINT))")))
        signs = _compared(probes.join(patterns, "pattern_id").select("pattern_id", "side", "rank", "pattern"), text, order, longest)
        before = F.col("sign") < F.col("side")  # side 0: smaller suffixes; side 1: also those that start with the pattern
        found = signs.groupBy("pattern_id", "side").agg(F.max(F.when(before, F.col("rank"))).alias("last"), F.min(F.when(~before, F.col("rank"))).alias("first"))
        moved = open_.join(found, ["pattern_id", "side"]).select("pattern_id", "side", F.coalesce(F.col("last") + 1, "lo").alias("lo"), F.coalesce("first", "hi").alias("hi"))
        moved = settle(moved, "open")
        closed = closed.unionByName(moved.where("lo >= hi"))
        open_ = moved.where("lo < hi")
    return closed.groupBy("pattern_id").agg(F.max(F.when(F.col("side") == 0, F.col("lo"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("lo"))).alias("r"))


def locate_sa(text: B.Text, order: B.Table, patterns: DataFrame) -> DataFrame:
    """pattern_id, l, r of patterns (pattern_id, pattern; not empty) by search in the whole array, without a q-mer table."""
    return search(text, order, patterns.select("pattern_id", "pattern", F.lit(0).cast("long").alias("l"), F.lit(text.n).cast("long").alias("r")))
