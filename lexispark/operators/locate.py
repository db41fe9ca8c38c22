"""Exact location of patterns as ranges [l, r) of the suffix array, and counting of their occurrences.

A pattern's range starts at the number of suffixes smaller than it. Suffixes and patterns meet on their first q symbols;
how many suffixes lie before a q-mer comes from one ordered running sum over q-mers and patterns together, so no pattern is
compared with more than its own q-mer's suffixes. An absent pattern has l = r.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from . import kmers
from .ranking import ranked

LAST = "\U0010ffff"


def qmer_table(strings: DataFrame, q: int) -> DataFrame:
    """qmer, l, r: the range of suffixes that start with it; shorter q-mers are whole suffixes."""
    counts = kmers.kmer_histogram(strings, q).withColumnRenamed("kmer", "qmer")
    return ranked(counts, ["qmer"], add="n").select("qmer", F.col("before").alias("l"), (F.col("before") + F.col("n")).alias("r"))


def budgeted_q(sigma: int, longest: int, budget: int = 1 << 22) -> int:
    """Symbols of a lookup table with at most `budget` entries of an alphabet of sigma symbols; 1 at least."""
    q = 1
    while q < longest and sigma ** (q + 1) <= budget:
        q += 1
    return q


def qmer_ranges(strings: DataFrame, patterns: DataFrame, q: int) -> DataFrame:
    """pattern_id, l, r of patterns of at most q symbols."""
    return table_ranges(kmers.kmer_histogram(strings, q).withColumnRenamed("kmer", "qmer"), patterns)


def table_ranges(counts: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern_id, l, r of patterns of at most as many symbols as the q-mers of counts (qmer, n) have."""
    entries = counts.select(F.col("qmer").alias("key"), F.lit(1).alias("kind"), "n", F.lit(None).cast("long").alias("pattern_id"))
    ask = lambda key, kind: patterns.select(key.alias("key"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("n"), "pattern_id")
    both = entries.unionByName(ask(F.col("pattern"), 0)).unionByName(ask(F.concat(F.col("pattern"), F.lit(LAST)), 2))
    order = ranked(both, ["key", "kind"], add="n").where("kind != 1")
    return order.groupBy("pattern_id").agg(F.max(F.when(F.col("kind") == 0, F.col("before"))).alias("l"), F.max(F.when(F.col("kind") == 2, F.col("before"))).alias("r"))


def locate(strings: DataFrame, patterns: DataFrame, q: int = 4) -> DataFrame:
    """pattern_id, l, r of every pattern (pattern_id, pattern; not empty) in strings (str_id, text)."""
    size = F.length("pattern")
    short = qmer_ranges(strings, patterns.where(size <= q), q)
    rest = settle(patterns.where(size > q).select("pattern_id", "pattern", F.substring("pattern", 1, q).alias("qmer")), "patterns")
    base = qmer_ranges(strings, rest.select("pattern_id", F.col("qmer").alias("pattern")), q).select("pattern_id", F.col("l").alias("base"))
    met = kmers.kmers(strings, q).withColumnRenamed("kmer", "qmer").join(rest, "qmer").join(strings, "str_id")
    stretch = F.substr("text", F.col("pos").cast("int") + 1, F.length("pattern"))
    counts = met.groupBy("pattern_id").agg(F.sum((stretch < F.col("pattern")).cast("long")).alias("less"), F.sum((stretch == F.col("pattern")).cast("long")).alias("hits"))
    found = base.join(counts, "pattern_id", "left").select("pattern_id", (F.col("base") + F.coalesce("less", F.lit(0).cast("long"))).alias("l"), F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))
    return short.unionByName(found.select("pattern_id", "l", (F.col("l") + F.col("hits")).alias("r")))


def occurrences(strings: DataFrame, patterns: DataFrame, q: int = 8) -> DataFrame:
    """pattern_id, str_id, pos of every occurrence of every pattern that isn't empty.

    Patterns meet the strings on their first q symbols; shorter ones on q-mers of their own length.
    """
    size = F.length("pattern")
    rest = patterns.where(size >= q).select("pattern_id", "pattern", F.substring("pattern", 1, q).alias("qmer"))
    met = kmers.kmers(strings, q).withColumnRenamed("kmer", "qmer").join(rest, "qmer").join(strings, "str_id")
    found = met.where(F.substr("text", F.col("pos").cast("int") + 1, F.length("pattern")) == F.col("pattern")).select("pattern_id", "str_id", "pos")
    for r in patterns.where((size > 0) & (size < q)).select(size.alias("n")).distinct().collect():  # fewer than q lengths
        short = patterns.where(size == r["n"]).select("pattern_id", F.col("pattern").alias("kmer"))
        found = found.unionByName(kmers.kmers(strings, r["n"]).join(short, "kmer").select("pattern_id", "str_id", "pos"))
    return found


def count_occurrences(strings: DataFrame, patterns: DataFrame, q: int = 4) -> DataFrame:
    """pattern_id and n of every pattern."""
    return locate(strings, patterns, q).select("pattern_id", (F.col("r") - F.col("l")).alias("n"))
