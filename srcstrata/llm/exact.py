"""Exact dedup in two passes with a Bloom filter, in built-in functions only.

Pass 1 sets two bits per text hash in a bounded filter and keeps the bits that
two rows set. Pass 2 tests every row: rows whose bits are not all there have no
copy and pass straight through; the others, all repeated texts and some false
hits, are shuffled by hash, where groups are counted exactly.

Defined cases: null text is the empty text; a null doc_id is smaller than any
id; of rows with the same text the one with the largest id stays; rows that
share that id too are repeated rows, of which ``deduplicate`` keeps one; an
empty table gives an empty one. Column names of the input do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcstrata.llm.bloom import flagged, seen_twice
from srcstrata.llm.common import lower_ascii, plain_names
from srcstrata.session import stored

HASH = "__text_sha256"


def text_hash(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased."""
    return F.sha2(lower_ascii(F.coalesce(text, F.lit(""))), 256)


def _split(hashed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows without a copy, rows that may have one, and (hash, keep_id, group_size) of the latter."""
    marked = flagged(hashed, HASH, seen_twice(hashed.select(HASH), HASH), "__maybe")
    alone = marked.filter(~F.col("__maybe")).drop("__maybe")
    maybe = marked.filter("__maybe").drop("__maybe")
    # Stored, so that both sides of the join are plain exchanges, of which hot ones can be split.
    groups = stored(maybe.groupBy(F.col(HASH).alias("__hash")).agg(
        F.max("doc_id").alias("__keep_id"), F.count("*").alias("__size")), "exact-groups")
    return alone, maybe, groups


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias(HASH))
    alone, maybe, groups = _split(hashed)
    # The group sizes are unique by hash; the side with hot hashes can be split.
    found = maybe.join(groups, F.col(HASH) == F.col("__hash")).select(
        "doc_id", F.col("__keep_id").alias("keep_id"), F.col("__size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("__keep_id")).alias("kept"), F.col(HASH).alias("text_sha256"))
    return found.unionByName(alone.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col(HASH).alias("text_sha256")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    plain, name = plain_names(docs)
    hashed = plain.withColumns({"doc_id": F.col(name["doc_id"]).cast("long"), HASH: text_hash(F.col(name["text"]))})
    alone, maybe, groups = _split(hashed)
    kept = (maybe.join(groups, (F.col(HASH) == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__keep_id")))
            .dropDuplicates([HASH]))
    return alone.select(plain.columns).unionByName(kept.select(plain.columns)).toDF(*docs.columns)
