"""Connected components of a graph given by its links, as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop, scratch


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node that has a link to another one.

    links: two columns of long. Alternates large-star and small-star steps until nothing changes, so the number of
    steps grows with the logarithm of the size; each step's links are written to the shared folder. Minima are
    aggregated before they are exchanged; joins are ordinary equi-joins, which Spark splits where a node is frequent.
    """
    spark, steps = links.sparkSession, []

    def stored(df: DataFrame) -> tuple[DataFrame, tuple]:
        steps.append(scratch(spark, "links"))
        df.write.parquet(steps[-1])
        back = spark.read.schema("u long, v long").parquet(steps[-1])
        mark = back.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        for old in steps[:-2]:
            drop(spark, old)
        del steps[:-2]
        return back, tuple(mark)

    a, b = links.columns
    edges, mark = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, now = stored(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
