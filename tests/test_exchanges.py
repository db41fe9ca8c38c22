"""Rows that grow with a text are exchanged in joins, never gathered in the driver for all tasks."""

import glob
import os

import pyarrow.parquet as pq
import pytest

from lexispark.operators.blocks import Table, packed
from lexispark.plans import catalog


def gathered(df) -> int:
    """Joins of a plan that send a whole side to all tasks by its keys."""
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


# joins with an alphabet, which is small whatever the text
@pytest.mark.parametrize(("name", "small"), [("shift_within_string", 2), ("bwt", 0), ("check_sa", 0), ("generalized_lc", 0), ("check_lcp", 0), ("gst_edges", 1)])
def test_joins_are_exchanges(spark, sf_dir, name, small):
    assert gathered(catalog.QUERIES[name](spark, sf_dir)) == small


def test_block_tables_are_read_in_small_parts(spark):
    """Rows of several MB: few of them in a row group of the file, and in a batch for Python."""

    def large(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from packed("block long, x binary", [(i, os.urandom(4 << 20))]).to_batches()

    def sizes(batches):
        for batch in batches:
            yield from packed("n long", [(batch.num_rows,)]).to_batches()

    table = Table(spark, "block long, x binary").append(spark.range(24).repartition(2).mapInArrow(large, "block long, x binary"))
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{table.path.removeprefix('file://')}/*.parquet")]
    assert sum(m.num_rows for m in files) == 24
    assert max(m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)) <= 3
    assert max(r["n"] for r in table.rows().mapInArrow(sizes, "n long").collect()) <= 2
    table.drop()
