"""Patterns that arrive as a stream, counted in a fixed set of strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kmers


def stream_occurrences(arriving: DataFrame, strings: DataFrame, q: int = 4) -> DataFrame:
    """pattern_id, pattern, str_id and pos for every occurrence of arriving patterns that aren't empty.

    Joins of a stream with static tables, so it runs without state and in append mode: the first min(q, length) symbols of
    a pattern meet the k-mers of that length, and what is met is compared in its string. k-mers hold no text.
    """
    found = arriving.withColumn("_n", F.least(F.length("pattern"), F.lit(q))).where("_n > 0")
    found = found.withColumn("qmer", F.substr("pattern", F.lit(1), F.col("_n")))
    index = kmers.kmers(strings, q).select("str_id", "pos", F.col("kmer").alias("_kmer"))
    keys = index.withColumn("_n", F.explode(F.sequence(F.lit(1), F.length("_kmer")))).select("str_id", "pos", "_n", F.substr("_kmer", F.lit(1), F.col("_n")).alias("qmer"))
    met = found.join(keys, ["_n", "qmer"]).join(strings.select("str_id", "text"), "str_id")
    return met.where(F.substr("text", F.col("pos").cast("int") + 1, F.length("pattern")) == F.col("pattern")).select("pattern_id", "pattern", "str_id", "pos")
