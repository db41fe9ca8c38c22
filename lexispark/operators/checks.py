"""Checkers as queries: each returns violation counts, all 0 for a right index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import exchanged, settle
from . import alphabet, rmq
from .suffix_array import SuffixArray


def check_sa(index: SuffixArray, strings: DataFrame) -> DataFrame:
    """missing (ranks or places without a row), repeated, and unordered adjacent suffixes."""
    chars = alphabet.characters(strings)
    n = chars.count()
    spark = strings.sparkSession
    sa = index.sa
    ranks = spark.range(n).select(F.col("id").alias("rank")).join(exchanged(sa), "rank", "left_anti").agg(F.count("*").alias("missing_ranks"))
    places = chars.join(exchanged(sa), ["str_id", "pos"], "left_anti").agg(F.count("*").alias("missing_places"))
    repeated = sa.groupBy("str_id", "pos").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeated"))
    after = sa.select("str_id", (F.col("pos") - 1).alias("pos"), F.col("rank").alias("then"))
    full = sa.join(exchanged(chars), ["str_id", "pos"]).join(exchanged(after), ["str_id", "pos"], "left").select("rank", "gidx", "ch", F.coalesce("then", F.lit(-1).cast("long")).alias("then"))
    before = full.select((F.col("rank") + 1).alias("rank"), F.col("ch").alias("b_ch"), F.col("then").alias("b_then"), F.col("gidx").alias("b_gidx"))
    pair = full.join(exchanged(before), "rank")
    # two suffixes that both end here are equal and stand in order of place
    wrong = (F.col("b_ch") > F.col("ch")) | ((F.col("b_ch") == F.col("ch")) & F.when((F.col("then") < 0) & (F.col("b_then") < 0), F.col("b_gidx") > F.col("gidx")).otherwise(F.col("b_then") > F.col("then")))
    unordered = pair.where(wrong).agg(F.count("*").alias("unordered"))
    out = ranks
    for part in (places, repeated, unordered):
        out = out.join(F.broadcast(part))  # one row each
    return out


def check_lcp(index: SuffixArray, lcp: DataFrame, strings: DataFrame) -> DataFrame:
    """wrong: values that don't follow from the others.

    Two neighbours share nothing if their first symbols differ; else one symbol more than the suffixes one place on,
    which share the smallest value between their ranks (nothing where one of them is the end).
    """
    chars = alphabet.characters(strings)
    after = index.sa.select("str_id", (F.col("pos") - 1).alias("pos"), F.col("rank").alias("then"))
    full = lcp.join(exchanged(chars), ["str_id", "pos"]).join(exchanged(after), ["str_id", "pos"], "left").select("rank", "lcp", "ch", "then")
    before = full.select((F.col("rank") + 1).alias("rank"), F.col("ch").alias("b_ch"), F.col("then").alias("b_then"))
    same = F.coalesce(F.col("ch") == F.col("b_ch"), F.lit(False)).alias("same")
    rows = settle(full.join(exchanged(before), "rank", "left").select("rank", "lcp", same, (F.col("b_then") + 1).alias("l"), (F.col("then") + 1).alias("r")), "pairs")
    goes_on = F.col("same") & (F.col("r") > F.coalesce("l", "r"))  # else nothing lies between the suffixes one place on
    asked = rows.where(goes_on).select(F.col("rank").alias("qid"), "l", "r", "lcp")
    least = rmq.bulk_rmq(asked, lcp.select(F.col("rank").alias("idx"), F.col("lcp").alias("v")))
    wrong = least.where(F.col("lcp") != 1 + F.coalesce("vmin", F.lit(0).cast("long"))).select("lcp")
    alone = rows.where(~F.coalesce(goes_on, F.lit(False)) & (F.col("lcp") != F.col("same").cast("long"))).select("lcp")
    return wrong.unionByName(alone).agg(F.count("*").alias("wrong"))


def check_suffix_tree(edges: DataFrame, n: int) -> DataFrame:
    """orphans (nodes without or with several parents), unreachable parents, and inner nodes with one child only."""
    children = edges.groupBy("child").agg(F.count("*").alias("n"))
    leaves = edges.sparkSession.range(n, 2 * n).select(F.col("id").alias("child")).join(exchanged(children), "child", "left_anti").agg(F.count("*").alias("missing_leaves"))
    several = children.where("n > 1").agg(F.count("*").alias("several_parents"))
    loose = edges.select(F.col("parent").alias("child")).where("child != 0").distinct().join(exchanged(children), "child", "left_anti").agg(F.count("*").alias("loose"))
    single = edges.where("parent != 0").groupBy("parent").agg(F.count("*").alias("n")).where("n < 2").agg(F.count("*").alias("single_child"))
    out = leaves
    for part in (several, loose, single):
        out = out.join(F.broadcast(part))  # one row each
    return out
