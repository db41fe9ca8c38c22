"""Suffix trees (and generalized ones) from suffix array, common prefixes and nearest smaller values.

Node ids: an internal node is the first index of its common-prefix interval (0 is the root), the leaf of rank i is n + i.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import exchanged, settle
from .ansv import ansv
from .suffix_array import SuffixArray


def parents(lcp: DataFrame) -> DataFrame:
    """parent, child, depth (of the parent) and rank (of a suffix below the child) of every node but the root."""
    n = lcp.count()
    values = settle(lcp.select(F.col("rank").alias("idx"), F.col("lcp").alias("v")), "lcp")
    left = ansv(values, "left", "furthest_eq", -1).select("idx", F.col("match").alias("f"))
    right = ansv(values, "right", "nearest_sm", -1).select("idx", F.col("match").alias("r"))
    ahead = values.select((F.col("idx") - 1).alias("idx"), F.col("v").alias("after"))
    rows = values.join(exchanged(left), "idx").join(exchanged(right), "idx").join(exchanged(ahead), "idx", "left")
    rows = rows.join(exchanged(values.select(F.col("idx").alias("f"), F.col("v").alias("lf"))), "f", "left").join(exchanged(values.select(F.col("idx").alias("r"), F.col("v").alias("lr"))), "r", "left")
    own = F.coalesce("after", F.lit(0).cast("long")) <= F.col("v")
    leaf = rows.select(
        F.when(~own, F.col("idx") + 1).when(F.col("lf") == F.col("v"), F.col("f")).otherwise(F.col("idx")).alias("parent"),
        (F.col("idx") + n).alias("child"),
        F.when(own, F.col("v")).otherwise(F.col("after")).alias("depth"),
        F.col("idx").alias("rank"),
    )
    to_left = F.col("lr").isNull() | (F.col("lf") >= F.col("lr"))
    inner = rows.where("v > 0 AND lf < v").select(F.when(to_left, F.col("f")).otherwise(F.col("r")).alias("parent"), F.col("idx").alias("child"), F.when(to_left, F.col("lf")).otherwise(F.col("lr")).alias("depth"), F.col("idx").alias("rank"))
    return leaf.unionByName(inner)


def suffix_tree(index: SuffixArray, lcp: DataFrame, chars: DataFrame, alphabet: DataFrame) -> DataFrame:
    """parent, code and child: edges by the code of their first symbol, 0 for the end of a string.

    In a generalized tree several edges of a node can have code 0, one for each string that ends there.
    """
    edges = parents(lcp).join(exchanged(index.sa.select("rank", "str_id", "pos")), "rank").withColumn("at", F.col("pos") + F.col("depth"))
    symbols = chars.join(F.broadcast(alphabet), "ch").select("str_id", F.col("pos").alias("at"), "code")
    return edges.join(exchanged(symbols), ["str_id", "at"], "left").select("parent", F.coalesce("code", F.lit(0).cast("long")).alias("code"), "child")


def node_table(edges: DataFrame, sigma: int) -> DataFrame:
    """One row for each internal node: parent, c0 ... c(sigma), with 0 where there is no child."""
    columns = [F.coalesce(F.max(F.when(F.col("code") == c, F.col("child"))), F.lit(0).cast("long")).alias(f"c{c}") for c in range(sigma + 1)]
    return edges.groupBy("parent").agg(*columns)


def generalized_edges(edges: DataFrame) -> DataFrame:
    """parent, code, child_lo, child_hi: the smallest and largest child of each symbol; they differ for code 0 only."""
    return edges.groupBy("parent", "code").agg(F.min("child").alias("child_lo"), F.max("child").alias("child_hi"))
