"""Command line: build, check and query text indexes; k-mer statistics, patterns, generated texts, dumps."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import alphabet, checks, ranking, suffix_tree, toplevel
from .operators import blocks as B
from .operators import suffix_array as S
from .plans.index import TextIndex
from .session import settle
from .sources import store, text


def _text(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Pieces of one string, of a whole file or of random DNA; with lines, a string of each line."""
    if getattr(a, "random", 0):
        piece = F.floor(F.col("pos") / 65536)
        parts = text.random_dna(spark, a.random, a.seed).groupBy(piece.alias("p")).agg(F.sort_array(F.collect_list(F.struct("pos", "ch"))).alias("s"))
        return parts.select(F.lit(0).cast("long").alias("str_id"), (F.col("p") * 65536).cast("long").alias("pos"), F.array_join(F.transform("s", lambda x: x["ch"]), "").alias("text"))
    if getattr(a, "lines", False):
        return text.line_strings(spark, a.file)
    return text.text_pieces(spark, a.file)


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    strings = settle(_text(spark, a), "strings")
    for _ in range(a.iterations):
        began = time.time()
        index = S.suffix_array(strings, a.k, a.times)
        n = index.sa.count()
        print(f"suffix array of {n} symbols: {time.time() - began:.2f} s")
    lcp = settle(S.lcp_array(index), "lcp") if a.lcp or a.tree or a.check or a.output else None
    if a.check:
        checks.check_sa(index, strings).show()
        checks.check_lcp(index, lcp, strings).show()
    edges = settle(suffix_tree.suffix_tree(index, lcp, alphabet.characters(strings), alphabet.codes(strings)), "edges") if a.tree else None
    if edges is not None:
        print(f"suffix tree: {edges.count()} edges")
        if a.check:
            checks.check_suffix_tree(edges, n).show()
    if a.output:
        TextIndex.build(strings, a.k, a.times).save(a.output)
        store.write_native(index.sa, f"{a.output}/sa64", "pos", "rank")
        store.write_native(lcp, f"{a.output}/lcp64", "lcp", "rank")
        if edges is not None:
            edges.write.mode("overwrite").parquet(f"{a.output}/tree")


def locate(spark: SparkSession, a: argparse.Namespace) -> None:
    index = TextIndex.load(spark, a.index) if a.index else TextIndex.build(settle(_text(spark, a), "strings"))
    if a.output:
        index.save(a.output)
    patterns = text.patterns(spark, a.patterns)
    for _ in range(a.iterations):
        began = time.time()
        found = settle(index.locate(patterns), "ranges")
        print(f"{found.count()} patterns, {found.where('r > l').count()} found: {time.time() - began:.2f} s")
    found.join(patterns, "pattern_id").orderBy("pattern_id").show(a.show, False)


def kmer_stats(spark: SparkSession, a: argparse.Namespace) -> None:
    counts = ranking.ranked(B.kmer_counts(B.of_strings(settle(_text(spark, a), "strings")), a.k), ["kmer"]).select(F.col("idx").alias("bin"), "n")
    for parts in toplevel.partitions(settle(counts, "bins"), [1 << p for p in range(1, 11)]):
        toplevel.imbalance(parts).show()


def make_patterns(spark: SparkSession, a: argparse.Namespace) -> None:
    strings = _text(spark, a) if a.random or a.lines else text.whole_texts(spark, a.file).select(F.lit(0).cast("long").alias("str_id"), "text")
    text.substring_patterns(strings.select("str_id", "text"), a.number, a.length).select("pattern").write.mode("overwrite").text(a.output)


def dump(spark: SparkSession, a: argparse.Namespace) -> None:
    for row in store.read_native(spark, a.file, a.width).orderBy("idx").toLocalIterator():
        print(row["v"])


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    top = argparse.ArgumentParser(prog="lexispark", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(name: str, run, source: bool = True) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("-f", "--file")
        if source:
            c.add_argument("-r", "--random", type=int, default=0, help="so many random DNA symbols instead of a file")
            c.add_argument("-s", "--seed", type=int, default=0)
            c.add_argument("--lines", action="store_true", help="a string of each line")
        return c

    c = command("build", build)
    c.add_argument("-k", type=int, default=0, help="symbols of the first keys; 0: as many as fit a word")
    c.add_argument("--times", type=int, default=0, help="2 doubles, 3 triples, ...; 0: automatic")
    c.add_argument("-i", "--iterations", type=int, default=1)
    for name in ("lcp", "tree", "check"):
        c.add_argument(f"-{name[0]}", f"--{name}", action="store_true")
    c.add_argument("-o", "--output")
    c = command("locate", locate)
    c.add_argument("-l", "--index")
    c.add_argument("-q", "--patterns", required=True)
    c.add_argument("-o", "--output")
    c.add_argument("-i", "--iterations", type=int, default=1)
    c.add_argument("--show", type=int, default=20)
    command("kmer-stats", kmer_stats).add_argument("-k", type=int, default=8)
    c = command("make-patterns", make_patterns)
    c.add_argument("number", type=int)
    c.add_argument("length", type=int)
    c.add_argument("output")
    command("dump", dump, source=False).add_argument("--width", type=int, default=8)
    a = top.parse_args(arguments)
    a.run(spark or SparkSession.builder.appName("lexispark").getOrCreate(), a)


if __name__ == "__main__":
    main()
