"""String sets: parsing, flattening, offsets, equal runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ranked


def parse(texts: DataFrame, separator: str, key: str = "text_id") -> DataFrame:
    """key, str_no and text: the strings between separators; runs of separators count once, so no string is empty."""
    parts = F.filter(F.split("text", f"\\Q{separator}\\E"), lambda s: s != "")
    return texts.select(key, F.posexplode(parts).alias("str_no", "text")).select(key, F.col("str_no").cast("long").alias("str_no"), "text")


def flatten(strings: DataFrame, separator: str, key: str = "text_id", order: str = "str_no") -> DataFrame:
    """key and text: each group's strings in order, a separator after each."""
    ordered = strings.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "text"))).alias("s"))
    return ordered.select(key, F.array_join(F.transform("s", lambda s: F.concat(s["text"], F.lit(separator))), "").alias("text"))


def offsets(strings: DataFrame) -> DataFrame:
    """str_id, begin, end: places of the strings (str_id, text or size) in their concatenation by str_id. Empty ones vanish."""
    size = F.col("size") if "size" in strings.columns else F.length("text")
    sizes = strings.where(size > 0).select("str_id", size.cast("long").alias("size"))
    return ranked(sizes, ["str_id"], add="size").select("str_id", F.col("before").alias("begin"), (F.col("before") + F.col("size")).alias("end"))


def equal_runs(values: DataFrame, index: str = "idx", value: str = "value") -> DataFrame:
    """value, begin, end: maximal runs of equal values at consecutive indexes."""
    ahead = values.select((F.col(index) + 1).alias(index), F.col(value).alias("_before"))
    behind = values.select((F.col(index) - 1).alias(index), F.col(value).alias("_after"))
    starts = values.join(ahead, index, "left").where(~F.col(value).eqNullSafe(F.col("_before"))).select(F.col(index).alias("begin"), value)
    ends = values.join(behind, index, "left").where(~F.col(value).eqNullSafe(F.col("_after"))).select(F.col(index).alias("end"))
    a = ranked(starts, ["begin"]).select("idx", "begin", value)
    b = ranked(ends, ["end"]).select("idx", (F.col("end") + 1).alias("end"))
    return a.join(b, "idx").select(value, "begin", "end")
