"""Distributed gathers, permutations and shifts, as equi-joins on explicit indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import exchanged

#: Rows of a vector that are sent to all tasks rather than exchanged, and bytes of a value at most.
REPLICATED, VALUE_BYTES = 1 << 20, 64


def bulk_gather(queries: DataFrame, vector: DataFrame, index: str = "idx", value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """queries (with column index) and the vector's value at that index; null beyond the vector. With keys (as a str_id),
    the index counts inside each string."""
    return queries.join(exchanged(vector.select(*keys, F.col("idx").alias(index), value)), [*keys, index], "left")


def replicated_gather(queries: DataFrame, vector: DataFrame, index: str = "idx", value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """bulk_gather from a vector that every task holds, where its checked size allows it: REPLICATED numbers or short
    values; a larger one is exchanged."""
    own = vector.select(*keys, F.col("idx").alias(index), value)
    n, widest = own.agg(F.count("*"), F.max(F.octet_length(F.col(value).cast("string")))).first()
    few = n <= REPLICATED and (widest or 0) <= VALUE_BYTES
    return queries.join(F.broadcast(own) if few else exchanged(own), [*keys, index], "left")


def bulk_query(queries: DataFrame, vector: DataFrame, answer: Callable[[DataFrame], Column], index: str = "idx", keys: tuple[str, ...] = ()) -> DataFrame:
    """queries with result = answer(joined row); answer gets the joined frame and returns a column."""
    joined = queries.join(exchanged(vector.withColumnRenamed("idx", index)), [*keys, index], "left")
    return joined.withColumn("result", answer(joined))


def bulk_permute(vector: DataFrame, target: str) -> DataFrame:
    """The vector with each value at its target index: only the key changes, nothing moves."""
    return vector.select(F.col(target).alias("idx"), *[c for c in vector.columns if c not in ("idx", target)])


def shift(vector: DataFrame, distance: int, value: str = "value", keys: tuple[str, ...] = (), index: str = "idx", out: str = "shifted") -> DataFrame:
    """vector with the value `distance` places further on (0 beyond the end); inside each string where keys are given."""
    ahead = vector.select(*keys, (F.col(index) - distance).alias(index), F.col(value).alias(out))
    return vector.join(exchanged(ahead), [*keys, index], "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


def multi_shift(vector: DataFrame, distance: int, times: int, value: str = "value", keys: tuple[str, ...] = (), index: str = "idx") -> DataFrame:
    """vector with b1, ..., b(times): values at distance, 2 distance, ..."""
    for j in range(1, times + 1):
        vector = shift(vector, j * distance, value, keys, index, f"b{j}")
    return vector


def bucketed(rows: DataFrame, key: str, buckets: int, index: str = "idx") -> DataFrame:
    """Rows dealt to partitions by key, with their original place (their index) in column place."""
    return rows.withColumn("place", F.col(index)).repartition(buckets, key)


def redistribute(vector: DataFrame, partitions: int, index: str = "idx") -> DataFrame:
    """The vector in even blocks of consecutive indexes."""
    return vector.repartitionByRange(partitions, index).sortWithinPartitions(index)


def partition_sizes(vector: DataFrame) -> DataFrame:
    """pid and n: rows of each partition."""
    return vector.groupBy(F.spark_partition_id().alias("pid")).agg(F.count("*").alias("n"))
