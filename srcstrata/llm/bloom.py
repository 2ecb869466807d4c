"""A blocked Bloom filter as a table of 64-bit words, in built-in functions.

A key's hash picks one word and two bits of it (Putze et al. 2007). The table
holds only words that are not zero, (word, bits), and has ``2 ** WORD_BITS``
rows at most: 4 million rows of 16 bytes, whatever the input's size. That bound
is what allows it to be broadcast. A fuller filter lets more keys pass; what it
says is exact in one direction only, so callers check what passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BITS = 22


def word_of(key: Column) -> Column:
    return F.xxhash64(key, F.lit(1)).bitwiseAND((1 << WORD_BITS) - 1)


def bits_of(key: Column) -> list[Column]:
    """Two different bits of the word."""
    h = F.xxhash64(key, F.lit(2))
    first = F.pmod(h, F.lit(64)).cast("int")
    step = F.pmod(F.shiftrightunsigned(h, 8), F.lit(63)).cast("int") + 1
    return [first, F.pmod(first + step, F.lit(64)).cast("int")]


def mask_of(key: Column) -> Column:
    a, b = bits_of(key)
    return _bit(a).bitwiseOR(_bit(b))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def seen_once(keys: DataFrame, key: str) -> DataFrame:
    """Filter of all keys."""
    return (keys.filter(F.col(key).isNotNull())
            .groupBy(word_of(F.col(key)).alias("word")).agg(F.bit_or(mask_of(F.col(key))).alias("bits")))


def seen_twice(keys: DataFrame, key: str) -> DataFrame:
    """Filter of keys that may occur in two rows or more: bits that two rows set.

    Rows of equal keys set the same bits, so no repeated key is missed.
    """
    places = keys.filter(F.col(key).isNotNull()).select(
        word_of(F.col(key)).alias("word"), F.explode(F.array(*bits_of(F.col(key)))).alias("bit"))
    return (places.groupBy("word", "bit").agg(F.count("*").alias("n")).filter("n > 1")
            .groupBy("word").agg(F.bit_or(_bit(F.col("bit"))).alias("bits")))


def flagged(df: DataFrame, key: str, words: DataFrame, flag: str) -> DataFrame:
    """``df`` with a column that is false only where the key is surely not in the filter."""
    mask = mask_of(F.col(key))
    joined = (df.withColumn("__word", word_of(F.col(key))).withColumn("__mask", mask)
              .join(F.broadcast(words.select(F.col("word").alias("__w"), F.col("bits").alias("__bits"))),
                    F.col("__word") == F.col("__w"), "left"))
    hit = F.col("__bits").bitwiseAND(F.col("__mask")) == F.col("__mask")
    return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__word", "__mask", "__w", "__bits")
