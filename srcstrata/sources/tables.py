"""Stored tables and the snapshot sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcstrata.operators.relational import null_safe_join
from srcstrata.schemas import TABLES

_BRANCH = ["repository_id", "branch_id"]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table with its declared schema, so no footer is read to infer one."""
    return spark.read.schema(TABLES[name].schema).parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str, names: Sequence[str] = tuple(TABLES)
                ) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name) for name in names}


def read_jdbc_table(spark: SparkSession, url: str, name: str, partition_column: str, lower: int,
                    upper: int, partitions: int, **options) -> DataFrame:
    """A table of an existing database, read in parallel ranges of a numeric column."""
    return spark.read.jdbc(url, name, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=options)


def write_snapshot(rows: DataFrame, scanned: DataFrame, folder: str) -> None:
    """Replaces all rows of every scanned (repository_id, branch_id) in a table folder.

    Only the partitions of scanned branches are overwritten. A branch scanned
    empty gets one marker row without a path in place of its old rows, so one
    job does the replacing and the clearing; :func:`read_snapshot` hides markers.
    Rebalancing gives each branch few files and splits a very large one.
    """
    empty = null_safe_join(scanned.select(*_BRANCH).distinct(), rows.select(*_BRANCH).distinct(),
                           _BRANCH, "left_anti")
    markers = empty.select(*[F.col(c) if c in _BRANCH else F.lit(None).cast(rows.schema[c].dataType)
                             .alias(c) for c in rows.columns])
    (rows.unionByName(markers).hint("rebalance", *_BRANCH)
     .write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
     .partitionBy(*_BRANCH).parquet(folder))


def read_snapshot(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = TABLES[name].schema
    return spark.read.schema(schema).parquet(folder).filter("path IS NOT NULL").select(
        *schema.fieldNames())
