"""Alphabets: histograms, dense codes, encoding, decoding; integer alphabets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def characters(strings: DataFrame) -> DataFrame:
    """str_id, pos, ch: one row for each code point of strings (str_id, text) or pieces of them (str_id, pos, text). A text
    is split once, in its own row."""
    parts = F.when(F.length("text") > 0, F.split("text", ""))
    first = F.col("pos") if "pos" in strings.columns else F.lit(0)
    each = strings.select("str_id", first.alias("_first"), F.posexplode(parts).alias("_at", "ch")).where("ch != ''")
    return each.select("str_id", (F.col("_first") + F.col("_at")).cast("long").alias("pos"), "ch")


def histogram(strings: DataFrame) -> DataFrame:
    """ch and n of all code points; partial counts are added before the exchange."""
    return strings.select(F.explode(F.split("text", "")).alias("ch")).where("ch != ''").groupBy("ch").agg(F.count("*").alias("n"))


def codes(strings: DataFrame) -> DataFrame:
    """ch and code: characters in code point order are 1, 2, ...; 0 stands for the end of a text.

    The window runs over different characters only, at most the code points of Unicode.
    """
    order = F.row_number().over(Window.orderBy("ch")).cast("long")
    return histogram(strings).select("ch", order.alias("code"))


def bits_for(sigma: int) -> int:
    """Bits of a symbol code, with code 0 for the end."""
    return max(1, math.ceil(math.log2(sigma + 1)))


def stats(strings: DataFrame) -> DataFrame:
    """sigma, bits_per_char, chars_per_word (of 63 usable bits) and unique_chars."""
    found = histogram(strings).agg(F.count("*").alias("sigma"), F.array_join(F.sort_array(F.collect_list("ch")), "").alias("unique_chars"))
    bits = F.greatest(F.lit(1), F.ceil(F.log2(F.col("sigma") + 1))).cast("long")
    return found.select(F.col("sigma").cast("long").alias("sigma"), bits.alias("bits_per_char"), F.floor(F.lit(63) / bits).cast("long").alias("chars_per_word"), "unique_chars")


def encode(chars: DataFrame, alphabet: DataFrame) -> DataFrame:
    """chars with code; a character outside the alphabet has a null code. An alphabet is small by its definition."""
    return chars.join(F.broadcast(alphabet), "ch", "left")


def decode(coded: DataFrame, alphabet: DataFrame) -> DataFrame:
    return coded.join(F.broadcast(alphabet), "code", "left")


def same_alphabet(a: DataFrame, b: DataFrame) -> bool:
    """Whether two alphabets have the same characters with the same codes."""
    return a.select("ch", "code").exceptAll(b.select("ch", "code")).isEmpty() and b.select("ch", "code").exceptAll(a.select("ch", "code")).isEmpty()


def integer_encode(values: DataFrame, value: str) -> DataFrame:
    """values with code = value - min + 1; the minimum is a partial aggregate of one row."""
    least = values.agg(F.min(value)).first()[0]
    return values.withColumn("code", (F.col(value) - F.lit(least) + 1).cast("long"))


def integer_decode(code: Column, least: int) -> Column:
    return code + F.lit(least) - 1
