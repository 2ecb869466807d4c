"""A bounded bitmap of keys: which rows may be worth a shuffle.

A key's hash picks one bit of ``2 ** (WORD_BITS + 6)``. The bitmap is a table of
its 64-bit words, (word, bits), of ``2 ** WORD_BITS`` rows and 16 MB at most,
whatever the input's size; that bound is what allows it to be broadcast. A
filled bitmap lets more rows pass; callers check what passes by an exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BITS = 20


def _place(*columns: Column) -> tuple[Column, Column]:
    """Word of a key and its bit in it. Nulls are part of a key, numbers of any width are alike."""
    h = F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\0")) for c in columns])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, WORD_BITS), F.lit(64)).cast("int"))
    return h.bitwiseAND((1 << WORD_BITS) - 1), bit


def bitmap(keys: DataFrame, *columns: str) -> DataFrame:
    """(word, bits) of all keys."""
    word, bit = _place(*map(F.col, columns))
    return keys.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))


def flagged(df: DataFrame, words: DataFrame, flag: str, *columns: str) -> DataFrame:
    """``df`` with a column that is false only where the key is surely not in the bitmap."""
    word, bit = _place(*map(F.col, columns))
    known = F.broadcast(words.select(F.col("word").alias("__word"), F.col("bits").alias("__bits")))
    return df.join(known, word == F.col("__word"), "left").withColumn(
        flag, F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__word", "__bits")


def maybe_in(df: DataFrame, words: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``df`` whose key may be in the bitmap; rows whose key is in it are never left out."""
    word, bit = _place(*map(F.col, columns))
    known = F.broadcast(words.select(F.col("word").alias("__word"), F.col("bits").alias("__bits")))
    return df.join(known, (word == F.col("__word")) & (F.col("__bits").bitwiseAND(bit) != 0), "left_semi")
