"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of a table that may hold any other columns; null text is empty."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else.

    Texts of single-byte characters go through the fast built-in ``lower``,
    which is the same there; others through a character map.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, upper, upper.lower())))


def hex64(value: Column) -> Column:
    """16 lower-case hex digits of a long."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named c0, c1, ... and the new name of each old one.

    Whatever the input's names, they then cannot clash with columns an operator
    adds; ``toDF`` of the old names brings them back.
    """
    inner = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*inner), dict(zip(reversed(docs.columns), reversed(inner)))


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in parts of few rows, so that few of its texts are Python objects at a time."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names))
