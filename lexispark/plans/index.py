"""A stored text index: text, suffix array, common prefixes, alphabet and q-mer table; built once, searched in bulk."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alphabet, locate, search
from ..operators import blocks as B
from ..operators import suffix_array as S
from ..session import settle
from ..sources import store


@dataclass
class TextIndex:
    """sa (rank, str_id, pos, gidx); lcp (rank, lcp); alphabet (ch, code); qmers (qmer, n), all q-mers of the text.

    text and order: text and suffix array in blocks, which location reads.
    """

    sa: DataFrame
    lcp: DataFrame
    alphabet: DataFrame
    qmers: DataFrame
    text: B.Text
    order: B.Table
    q: int

    @classmethod
    def build(cls, strings: DataFrame, k: int = 0, times: int = 0, budget: int = 1 << 22) -> TextIndex:
        """budget: entries of the q-mer table at most, from which q follows."""
        codes = settle(alphabet.codes(strings), "alphabet")
        index = S.suffix_array(strings, k, times)
        q = locate.budgeted_q(codes.count(), max(1, index.text.longest), budget)
        qmers = settle(B.kmer_counts(index.text, q).withColumnRenamed("kmer", "qmer"), "qmers")
        return cls(index.sa, S.lcp_array(index).select("rank", "lcp"), codes, qmers, index.text, search.order_blocks(index.text, index.ranks), q)

    def save(self, path: str) -> None:
        store.write_index(path, sa=self.sa, lcp=self.lcp, alphabet=self.alphabet)
        self.qmers.write.mode("overwrite").parquet(f"{path}/qmers")
        self.text.table.save(f"{path}/text")
        self.order.save(f"{path}/order")
        symbols = [int(s) for s in self.text.symbols]
        head = self.qmers.sparkSession.createDataFrame([(self.text.n, self.text.size, self.text.longest, self.q, self.text.table.buckets, self.order.buckets, symbols)], _HEAD)
        head.write.mode("overwrite").parquet(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextIndex:
        """Raises where the stored parts differ in size."""
        parts = store.read_index(spark, path, "sa", "lcp", "alphabet")
        head = spark.read.schema(_HEAD).parquet(f"{path}/head").first()
        tables = (B.Table.stored(spark, schema, f"{path}/{name}", buckets) for schema, name, buckets in ((B.TEXT, "text", head["text_buckets"]), (search.ORDER, "order", head["order_buckets"])))
        text, order = tables
        kept = B.Text(spark, text, head["n"], head["size"], head["longest"], np.int32, np.array(head["symbols"], np.int64))
        return cls(parts["sa"], parts["lcp"], parts["alphabet"], spark.read.parquet(f"{path}/qmers"), kept, order, head["q"])

    def locate(self, patterns: DataFrame) -> DataFrame:
        """pattern_id, l, r: the range of ranks whose suffixes start with each pattern (pattern_id, pattern; not empty).

        The first q symbols are looked up in the q-mer table; longer patterns are searched in that range.
        """
        size = F.length("pattern")
        asked = settle(patterns.select("pattern_id", "pattern"), "patterns")
        head = locate.table_ranges(self.qmers, asked.select("pattern_id", F.substring("pattern", 1, self.q).alias("pattern")))
        known = settle(asked.join(head, "pattern_id"), "known")
        return known.where(size <= self.q).select("pattern_id", "l", "r").unionByName(search.search(self.text, self.order, known.where(size > self.q)))

    def locate_possible(self, patterns: DataFrame) -> DataFrame:
        """pattern_id, l, r from the q-mer table alone: a range that holds the pattern's, exact up to q symbols."""
        return locate.table_ranges(self.qmers, patterns.select("pattern_id", F.substring("pattern", 1, self.q).alias("pattern")))

    def count(self, patterns: DataFrame) -> DataFrame:
        """pattern_id and n: how often each pattern occurs."""
        return self.locate(patterns).select("pattern_id", (F.col("r") - F.col("l")).alias("n"))

    def places(self, patterns: DataFrame) -> DataFrame:
        """pattern_id, rank, str_id, pos of all occurrences, through the ranges."""
        ranges = self.locate(patterns).where("r > l").selectExpr("pattern_id", "explode(sequence(l, r - 1)) AS rank")
        return ranges.join(self.sa, "rank").select("pattern_id", "rank", "str_id", "pos")


_HEAD = "n long, size long, longest long, q int, text_buckets int, order_buckets int, symbols array<long>"
