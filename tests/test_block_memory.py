"""What tasks hold of packed rows stays small."""

import glob
import random

import numpy as np
import pyarrow.parquet as pq
from brute import lcp_list, suffix_rows
from pyspark.sql import functions as F

from lexispark.operators import common_prefix
from lexispark.operators import suffix_array as S
from lexispark.operators.blocks import Table, packed


def test_writer_keeps_no_extremes_of_packed_columns(spark):
    """A writer holds the least and greatest value of every row group until its file ends: of packed rows all of them."""

    def rows(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from packed("block long, round int, x binary", [(i, 1, np.arange(4))]).to_batches()

    table = Table(spark, "block long, round int, x binary").append(spark.range(8).mapInArrow(rows, "block long, round int, x binary"))
    found = [pq.ParquetFile(f).metadata for f in glob.glob(f"{table.path.removeprefix('file://')}/*.parquet")]
    kept = {(c.path_in_schema, bool(c.statistics and c.statistics.has_min_max)) for m in found for i in range(m.num_row_groups) for c in (m.row_group(i).column(j) for j in range(3))}
    assert kept == {("block", True), ("round", True), ("x", False)}
    table.drop()


def test_compared_windows_have_a_bound(spark, monkeypatch):
    """Many long repeats: a block's windows are cut to a number of symbols a round, and common prefixes stay right."""
    random.seed(5)
    passages = ["".join(random.choices("abcdefgh", k=150)) for _ in range(40)]
    texts = [f"{a}{p}{z}" for p in passages for a, z in (("x", "y"), ("z", "w"))]
    sent, meet = [], common_prefix.meet

    def spied(left, right, work, schema):
        out = meet(left, right, work, schema)
        if schema == common_prefix._SENT:
            sent.append(out.agg(F.sum(F.length("codes")), F.sum(F.length("g"))).first())
        return out

    monkeypatch.setattr(common_prefix, "meet", spied)
    monkeypatch.setattr(common_prefix, "SENT", 64, raising=False)
    found = S.lcp_array(S.suffix_array(spark.createDataFrame(list(enumerate(texts)), "str_id long, text string")))
    assert [r["lcp"] for r in found.orderBy("rank").collect()] == lcp_list(suffix_rows(list(enumerate(texts))))
    blocks = 4 * 4  # of the session's partitions
    assert all(codes <= blocks * 64 + common_prefix.WINDOW * pairs // 8 for codes, pairs in sent)
