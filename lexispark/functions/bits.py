"""Bit and packed-word functions over BIGINT columns, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _width(x: Column) -> Column:
    """Binary digits of a non-negative number; 0 has one digit."""
    return F.length(F.bin(x)).cast("long")


def floor_log2(x: Column) -> Column:
    return _width(x) - 1


def ceil_log2(x: Column) -> Column:
    """0 for 1; null for numbers below 1."""
    return F.when(x == 1, F.lit(0).cast("long")).when(x > 1, _width(x - 1))


def trailing_zeros(x: Column, width: int = 64) -> Column:
    """Zeros below the lowest set bit; width for 0."""
    return F.when(x == 0, F.lit(width).cast("long")).otherwise(F.length(F.bin(x)).cast("long") - F.length(F.rtrim(F.bin(x), F.lit("0"))).cast("long"))


def leading_zeros(x: Column, width: int = 64) -> Column:
    """Zeros above the highest set bit of a word of the given width; width for 0."""
    return F.when(x == 0, F.lit(width).cast("long")).otherwise(F.lit(width).cast("long") - _width(x))


def lcp_bitwise(x: Column, y: Column, k: int, bits: int) -> Column:
    """Leading symbols that two words of k symbols of the given number of bits share."""
    differ = x.bitwiseXOR(y)
    return F.when(differ == 0, F.lit(k).cast("long")).otherwise(F.floor((F.lit(k * bits) - _width(differ)) / bits).cast("long"))


def lcp_bitwise_no0(x: Column, y: Column, k: int, bits: int) -> Column:
    """The same, without the zero symbols at the end of the words."""
    held = F.when(x == 0, F.lit(0).cast("long")).otherwise(F.lit(k).cast("long") - F.floor(trailing_zeros(x) / bits).cast("long"))
    return F.least(lcp_bitwise(x, y, k, bits), held)


def packed_symbol(word: Column, i: int, k: int, bits: int) -> Column:
    """Code of symbol i (from the left) of a packed word of k symbols."""
    return F.shiftrightunsigned(word, bits * (k - 1 - i)).bitwiseAND(F.lit((1 << bits) - 1))
