"""Join and ranking helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi join in which null keys are equal; keys come from the left side.

    ``<=>`` stays a hash or sort-merge join key, unlike an OR over IS NULL.
    """
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__right_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__right_{k}" for k in keys])


def top1_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key.

    Spark limits each map partition to one row per key before the shuffle, so a
    hot key sends one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def rank_in_group(df: DataFrame, group: str, order: str, buckets: int = 256) -> DataFrame:
    """``row_number`` by ``order`` inside each group, for groups of any size.

    A plain window would put a hot group into one task. Here the order values
    are cut into ranges at split points drawn from the data; rows are numbered
    inside (group, range) and moved up by the sizes of the ranges before. Any
    split points give the same numbers, they only balance the work.
    """
    drawn = df.groupBy(F.pmod(F.xxhash64(order), F.lit(buckets - 1)).alias("__class")).agg(
        F.max_by(order, F.xxhash64(F.col(order), F.lit(1))).alias("__split"))
    splits = drawn.agg(F.array_sort(F.collect_list("__split"))).scalar()
    cut = df.withColumn("__splits", splits).withColumn(
        "__range", F.size(F.filter("__splits", lambda s: s <= F.col(order)))).drop("__splits")
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(group, "__range").agg(F.count("*").alias("__n")).select(
        group, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy(group, "__range").orderBy(order)
    return (cut.join(offsets, [group, "__range"])
            .withColumn("rank", F.col("__offset") + F.row_number().over(within))
            .drop("__range", "__offset"))
