"""Global order without a single-partition window: sorted positions, ranks of equal runs, prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle, shuffle_partitions


_EXTRA = [("_pid", T.IntegerType()), ("_li", T.LongType()), ("_run", T.LongType()), ("_single", T.BooleanType()), ("_sum", T.LongType())]


def _numbered(df: DataFrame, keys: list[str], add: str | None) -> DataFrame:
    """Rows with partition, index in it, index of the first row with equal keys, whether no other row has these keys,
    and the running sum before the row."""
    at = [df.columns.index(k) for k in keys]
    value = df.columns.index(add) if add else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, count, run, total, last, held = TaskContext.get().partitionId(), 0, 0, 0, None, None

        def finished(entry: tuple, again: bool) -> pa.RecordBatch:
            """A batch, once it is known whether the next one starts with the same keys."""
            batch, li, runs, fresh, before = entry
            single = fresh & np.append(fresh[1:], not again)
            out = [pa.array(np.full(batch.num_rows, pid, np.int32)), pa.array(li), pa.array(runs), pa.array(single), pa.array(before)]
            return pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *(n for n, _ in _EXTRA)])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(i) for i in at]
            fresh = np.zeros(n, bool)
            for c in columns:
                fresh[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool)
            first = tuple(c[0].as_py() for c in columns)
            fresh[0] = first != last
            if held:
                yield finished(held, first == last)
            last = tuple(c[n - 1].as_py() for c in columns)
            li = np.arange(count, count + n)
            runs = np.maximum.accumulate(np.where(fresh, li, run))
            run = int(runs[-1])
            sums = np.cumsum(batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)) if add else np.zeros(n, np.int64)
            before = np.concatenate([[0], sums[:-1]]) + total
            total += int(sums[-1])
            count += n
            held = batch, li, runs, fresh, before
        if held:
            yield finished(held, False)

    # rows with equal keys are told apart by a hash, so that a frequent key is spread over partitions
    ordered = df.withColumn("_salt", F.xxhash64(*df.columns)).repartitionByRange(shuffle_partitions(df.sparkSession), *keys, "_salt").drop("_salt").sortWithinPartitions(*keys)
    return settle(ordered.mapInArrow(work, T.StructType([*df.schema.fields, *(T.StructField(*x) for x in _EXTRA)])), "order")


def ranked(df: DataFrame, keys: list[str], add: str | None = None) -> DataFrame:
    """df with idx (0-based position by keys), bucket (idx of the first row with equal keys) and single (whether no
    other row has these keys).

    With add, also before: the sum of that column over all rows in front. Rows are range-partitioned; where equal keys lie
    in several partitions, their run is carried over the borders. The numbers are stored before they are used, as another
    run might draw other bounds. Only one row for each partition reaches the driver.
    """
    rows = _numbered(df, keys, add)
    spark = df.sparkSession
    own = F.struct(*keys)
    parts = rows.groupBy("_pid").agg(
        F.count("*").alias("n"), F.max(F.col("_sum") + (F.col(add) if add else F.lit(0))).alias("s"), F.min_by(own, "_li").alias("first"), F.max_by(own, "_li").alias("last"), F.max("_run").alias("run")
    ).orderBy("_pid").collect()
    offsets, n, s, start = [], 0, 0, 0
    for i, r in enumerate(parts):
        again = i > 0 and r["first"] == parts[i - 1]["last"]  # the first run began in a partition before
        more = i + 1 < len(parts) and parts[i + 1]["first"] == r["last"]
        head = start if again else n
        offsets.append((r["_pid"], n, s, head, again, r["run"] if more else -1))
        start = n + r["run"] if r["run"] else head
        n, s = n + r["n"], s + (r["s"] or 0)
    table = spark.createDataFrame(offsets, "_pid int, _n long, _s long, _head long, _again boolean, _more long")
    joined = rows.join(F.broadcast(table), "_pid")
    bucket = F.when(F.col("_run") == 0, F.col("_head")).otherwise(F.col("_run") + F.col("_n"))
    single = F.col("_single") & ~(F.col("_again") & (F.col("_run") == 0)) & (F.col("_run") != F.col("_more"))
    extra = [(F.col("_li") + F.col("_n")).alias("idx"), bucket.alias("bucket"), single.alias("single")]
    if add:
        extra.append((F.col("_sum") + F.col("_s")).alias("before"))
    return joined.select(*df.columns, *extra)


def active(buckets: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Rows whose bucket holds more than one row; counts are added before the exchange."""
    several = buckets.groupBy(bucket).agg(F.count("*").alias("_n")).where("_n > 1").select(bucket)
    return buckets.join(several, bucket, "left_semi")


def fill_forward(df: DataFrame, order: str, value: str) -> DataFrame:
    """df with filled: the last value above zero at or before each row, 0 before the first.

    A row learns the last marked row of the partitions in front from one row for each partition.
    """
    spark = df.sparkSession
    mark = df.columns.index(value)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, held = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(mark).fill_null(0).to_numpy().astype(np.int64)
            at = np.maximum.accumulate(np.where(v > 0, np.arange(len(v)), -1))
            out = np.where(at >= 0, v[at], held)
            held = int(out[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(v), pid, np.int32)), pa.array(out)], names=[*batch.schema.names, "_pid", "_last"])

    ordered = df.repartitionByRange(shuffle_partitions(spark), order).sortWithinPartitions(order)
    rows = settle(ordered.mapInArrow(work, T.StructType([*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_last", T.LongType())])), "filled")
    ends = rows.groupBy("_pid").agg(F.max_by("_last", order).alias("v")).orderBy("_pid").collect()
    carried, held = [], 0
    for r in ends:
        carried.append((r["_pid"], held))
        held = r["v"] or held
    table = spark.createDataFrame(carried, "_pid int, _held long")
    return rows.join(F.broadcast(table), "_pid").select(*df.columns, F.when(F.col("_last") == 0, F.col("_held")).otherwise(F.col("_last")).alias("filled"))
