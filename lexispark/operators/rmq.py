"""Range-minimum queries in bulk: leftmost position, value and payload of the minimum of [l, r)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import exchanged, settle

BLOCK = 64


def bulk_rmq(queries: DataFrame, values: DataFrame, payload: str | None = None, block: int = BLOCK) -> DataFrame:
    """queries (qid, l, r; r exclusive) with argmin, vmin and the payload at the minimum; null for empty ranges.

    Two levels: running minima from both ends of each block of consecutive indexes, and minima over powers of two of
    whole blocks. A query inside one block reads at most a block's rows.
    """
    entry = F.struct(F.col("v"), F.col("idx"), *([F.col(payload).alias("payload")] if payload else []))
    rows = values.select(F.floor(F.col("idx") / block).cast("long").alias("b"), "idx", entry.alias("e"))
    w = Window.partitionBy("b").orderBy("idx")
    back = Window.partitionBy("b").orderBy(F.desc("idx"))
    ends = settle(rows.select("b", "idx", "e", F.min("e").over(w).alias("ahead"), F.min("e").over(back).alias("behind")), "ends")
    level = ends.groupBy("b").agg(F.min("e").alias("m"))
    n = (level.agg(F.max("b")).first()[0] or 0) + 1
    tables, span = [settle(level.select(F.lit(0).alias("k"), "b", "m"), "level")], 1
    while 2 * span <= n:
        last = tables[-1]
        ahead = last.select((F.col("b") - span).alias("b"), F.col("m").alias("m2"))
        tables.append(settle(last.join(exchanged(ahead), "b").select((F.col("k") + 1).alias("k"), "b", F.least("m", "m2").alias("m")), "level"))
        span *= 2
    table = tables[0]
    for t in tables[1:]:
        table = table.unionByName(t)
    q = queries.where("r > l").select("qid", "l", (F.col("r") - 1).alias("z"), F.floor(F.col("l") / block).cast("long").alias("x"), F.floor((F.col("r") - 1) / block).cast("long").alias("y"))
    inside = q.where("x = y").join(exchanged(ends.select(F.col("b").alias("x"), "idx", "e")), "x").where("idx BETWEEN l AND z").groupBy("qid").agg(F.min("e").alias("e"))
    wide = q.where("x < y")
    left = wide.join(exchanged(ends.select(F.col("idx").alias("l"), F.col("behind").alias("e"))), "l").select("qid", "e")
    right = wide.join(exchanged(ends.select(F.col("idx").alias("z"), F.col("ahead").alias("e"))), "z").select("qid", "e")
    middle = wide.where("y - x > 1").withColumn("k", (F.length(F.bin(F.greatest(F.col("y") - F.col("x") - 1, F.lit(1)))) - 1).cast("int"))
    first = middle.select("qid", "k", (F.col("x") + 1).alias("b"))
    second = middle.select("qid", "k", F.expr("y - shiftleft(1L, k)").alias("b"))
    across = first.unionByName(second).join(exchanged(table), ["k", "b"]).select("qid", F.col("m").alias("e"))
    best = inside.unionByName(left).unionByName(right).unionByName(across).groupBy("qid").agg(F.min("e").alias("e"))
    columns = [F.col("e.idx").alias("argmin"), F.col("e.v").alias("vmin"), *([F.col("e.payload").alias(payload)] if payload else [])]
    return queries.join(exchanged(best), "qid", "left").select(*queries.columns, *columns)
