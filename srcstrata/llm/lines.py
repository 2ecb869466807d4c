"""Repeated line runs by a suffix array over line ids, built by prefix doubling.

Lines with a word are numbered over the whole corpus in one order; a document
is the sequence of its line numbers. Suffixes are ranked by their first line,
then by 2, 4, ... lines, each round from pairs of ranks of the round before,
until the order reaches ``min_lines``. Neighbours in that order whose common
prefix is ``min_lines`` or longer form an interval; the suffix of an interval
that comes first in the corpus is the first copy, the others start later copies.
Starts that follow one another join into maximal repeated runs, whose lines are
deleted. Deeper rounds would sort inside intervals and change no interval.

Ranks are given in ranges cut from the data, groups are reduced to their
first copy before they are shuffled back, and what is joined on a hot rank is
the side that adaptive execution can split.

Defined cases: the corpus order is (doc_id, text hash, line), null ids first;
null text has no lines; lines without a word are never deleted; lines are equal
when all their characters are; repeated rows (same id, same text) are one
document here, for neither comes first; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcstrata.llm.common import texts
from srcstrata.session import stored

MIN_LINES = 2
HAS_WORD = r"[^\x20\x09-\x0D]"


def _keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("hash", F.xxhash64("text"))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, line, place, id): lines with a word; place counts them, id names their text."""
    lines = (_keyed(docs).dropDuplicates(["doc_id", "hash"])
             .select("doc_id", "hash", F.filter(F.transform(
                 F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("said"))),
                 lambda x: x["said"].rlike(HAS_WORD)).alias("said"))
             .select("doc_id", "hash", F.posexplode("said").alias("place", "x"))
             .select("doc_id", "hash", "place", "x.line", F.xxhash64("x.said").alias("a"),
                     F.xxhash64("x.said", F.lit(1)).alias("b")))
    return _ranked(stored(lines, "lines"))


def _ranked(pairs: DataFrame) -> DataFrame:
    """Replaces ``a`` and ``b`` by ``id``, which orders and names the pair among all pairs.

    Distinct pairs are dealt out in ranges and sorted; ids grow with the range
    and the place in it, without being dense. They are stored before use.
    """
    ranks = stored(pairs.select(F.col("a").alias("__a"), F.col("b").alias("__b")).distinct()
                   .repartitionByRange("__a", "__b").sortWithinPartitions("__a", "__b")
                   .withColumn("id", F.monotonically_increasing_id()), "line-pairs")
    named = pairs.join(ranks, (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")))
    return stored(named.drop("a", "b", "__a", "__b"), "line-ranks")


def ranked_suffixes(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Suffixes of ``min_lines`` lines or more with their rank by that many lines."""
    if min_lines < 1:
        raise ValueError("min_lines must be positive")
    ranks, width = numbered_lines(docs), 1
    inside = Window.partitionBy("doc_id", "hash").orderBy("place")
    while width < min_lines:
        step = min(width, min_lines - width)  # the last round's prefixes may overlap
        pairs = (ranks.withColumn("b", F.lead("id", step).over(inside)).filter("b IS NOT NULL")
                 .withColumnRenamed("id", "a"))
        ranks, width = _ranked(pairs), width + step
    return ranks


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Suffixes (doc_id, hash, place) whose first ``min_lines`` lines occur earlier in the corpus."""
    suffixes = ranked_suffixes(docs, min_lines)
    spot = F.struct("doc_id", "hash", "place")
    intervals = (suffixes.groupBy(F.col("id").alias("__id")).agg(F.min(spot).alias("first"), F.count("*").alias("n"))
                 .filter("n > 1").select("__id", "first"))
    return (suffixes.join(intervals, F.col("id") == F.col("__id")).filter(spot != F.col("first"))
            .select("doc_id", "hash", "place", "first"))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Maximal runs of deleted lines: (doc_id, hash, start, end), counted in lines with a word, end exclusive."""
    order = Window.partitionBy("doc_id", "hash").orderBy("place")
    joined = (later_copies(docs, min_lines)
              .withColumn("new", (F.col("place") - F.lag("place", 1, -10**9).over(order) > min_lines).cast("int"))
              .withColumn("run", F.sum("new").over(order)))
    return joined.groupBy("doc_id", "hash", "run").agg(
        F.min("place").alias("start"), (F.max("place") + min_lines).alias("end")).drop("run")


def deleted_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Every row's text without later copies: (doc_id, n_lines, n_removed, kept)."""
    runs = repeated_runs(docs, min_lines).groupBy(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")).agg(
        F.collect_list(F.struct("start", "end")).alias("runs"))
    keyed = _keyed(docs)
    joined = keyed.join(runs, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash")), "left")
    lines = F.split("text", "\n")
    counted = joined.withColumn("lines", lines).withColumn(
        "worded", F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(HAS_WORD), i)), lambda i: i.isNotNull()))
    gone = F.flatten(F.transform(F.coalesce("runs", F.array().cast("array<struct<start:int,end:int>>")),
                                 lambda r: F.slice(F.col("worded"), r["start"] + 1, r["end"] - r["start"])))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")),
                       lambda i: F.get(F.col("lines"), i))
    return counted.withColumn("gone", gone).select(
        "doc_id", F.size("worded").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"),
        F.array_join(kept, "\n").alias("kept"))
