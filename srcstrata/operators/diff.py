"""Difference of two snapshots of a tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcstrata.functions.text import split_lines
from srcstrata.operators.bitmap import bitmap, maybe_in
from srcstrata.operators.relational import rank_in_group
from srcstrata.session import stored


def _digest(snapshot: DataFrame) -> DataFrame:
    return snapshot.select("path", F.sha2("content", 256).alias("sha"),
                           F.size(split_lines(F.col("content"))).alias("n_lines"))


def snapshot_file_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """``path, old_path, change_type, additions, deletions`` from base to head.

    Both inputs are (path, content) with unique paths. Every text is hashed once
    and the paths with their hashes are stored; texts of modified files are read
    again to hash their lines. No text is shuffled.

    * same path, other content: ``modified``, lines counted as a multiset difference;
    * a new path with the content of a vanished one: ``renamed``, paired in path order;
    * another new path whose content the base holds: ``copied`` from the smallest such path;
    * what is left: ``added`` or ``deleted``.
    """
    b = _digest(base).withColumnsRenamed({"sha": "base_sha", "n_lines": "base_lines"})
    h = _digest(head).withColumnsRenamed({"sha": "head_sha", "n_lines": "head_lines"})
    both = stored(b.join(h, "path", "full_outer"), "paths")
    return _changes(both, _modified(both, base, head))


def index_changes(base: DataFrame, head: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same per tree, from indexes: ``keys``, path, old_path, change_type, additions, deletions.

    An index has a row per file: the ``keys`` that name its tree, path, sha, and
    ``line_hashes``, an array of its lines' hashes. No text is read.
    """
    def side(index: DataFrame, name: str) -> DataFrame:
        """A path is a path in its tree, and a content the content of a file of that tree."""
        tree = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], "sha")
        empty = {f"{other}_{c}": F.lit(None).cast(kind) for other in ("base", "head") if other != name
                 for c, kind in (("sha", "string"), ("hashes", "array<bigint>"))}
        return index.select(F.struct(*keys, "path").alias("path"), tree.alias(f"{name}_sha"),
                            F.col("line_hashes").alias(f"{name}_hashes")).withColumns(empty)
    both = stored(side(base, "base").unionByName(side(head, "head")).groupBy("path").agg(
        *[F.max(c).alias(c) for c in ("base_sha", "base_hashes", "head_sha", "head_hashes")]), "paths")
    changed = both.filter("base_sha <> head_sha")

    def lines(name: str, sign: int) -> DataFrame:
        return changed.select("path", F.explode(f"{name}_hashes").alias("line"), F.lit(sign).alias("sign"))
    balance = lines("head", 1).unionByName(lines("base", -1)).groupBy("path", "line").agg(F.sum("sign").alias("n"))
    sized = both.select("path", "base_sha", "head_sha", F.size("base_hashes").alias("base_lines"),
                        F.size("head_hashes").alias("head_lines"))
    found = _changes(sized, _counted(changed.select("path"), balance))
    return found.select(*[F.col(f"path.{k}").alias(k) for k in keys], F.col("path.path").alias("path"),
                        F.col("old_path.path").alias("old_path"), "change_type", "additions", "deletions")


def _changes(both: DataFrame, modified: DataFrame) -> DataFrame:
    """Changes from (path, base_sha, base_lines, head_sha, head_lines), with those of modified paths given."""
    gone = both.filter("head_sha IS NULL").select("path", F.col("base_sha").alias("sha"),
                                                  F.col("base_lines").alias("n_lines"))
    come = both.filter("base_sha IS NULL").select("path", F.col("head_sha").alias("sha"),
                                                  F.col("head_lines").alias("n_lines"))
    pairs = _pair_by_path_order(come, gone)
    return (
        modified
        .unionByName(pairs.select(
            "path", "old_path", F.lit("renamed").alias("change_type"),
            F.lit(0).alias("additions"), F.lit(0).alias("deletions")))
        .unionByName(_copied_or_added(come.join(pairs, "path", "left_anti"),
                                      both.filter("base_sha IS NOT NULL")))
        .unionByName(gone.join(pairs.select(F.col("old_path").alias("path")), "path", "left_anti")
                     .select("path", F.lit(None).cast(both.schema["path"].dataType).alias("old_path"),
                             F.lit("deleted").alias("change_type"),
                             F.lit(0).alias("additions"), F.col("n_lines").alias("deletions")))
    )


def _pair_by_path_order(come: DataFrame, gone: DataFrame) -> DataFrame:
    """(path, old_path) of the n-th new and the n-th vanished path per content."""
    come_hashes = come.select("sha").distinct()
    gone_hashes = gone.select("sha").distinct()
    new = rank_in_group(come.select("path", "sha").join(gone_hashes, "sha", "left_semi"),
                        "sha", "path")
    old = rank_in_group(gone.select("path", "sha").join(come_hashes, "sha", "left_semi"),
                        "sha", "path").withColumnRenamed("path", "old_path")
    return new.join(old, ["sha", "rank"]).select("path", "old_path")


def _copied_or_added(come: DataFrame, base: DataFrame) -> DataFrame:
    smallest = base.groupBy(F.col("base_sha").alias("sha")).agg(F.min("path").alias("old_path"))
    found = come.join(smallest, "sha", "left")
    is_copy = F.col("old_path").isNotNull()
    return found.select(
        "path", "old_path", F.when(is_copy, "copied").otherwise("added").alias("change_type"),
        F.when(is_copy, 0).otherwise(F.col("n_lines")).alias("additions"),
        F.lit(0).alias("deletions"))


def _modified(both: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    """Modified paths with the lines they gained and lost.

    A bounded bitmap of the modified paths picks the texts where they are read;
    what is shuffled is a 128-bit hash per distinct line of a text, and its count.
    """
    paths = both.filter("base_sha <> head_sha").select("path")
    modified = bitmap(paths, "path")

    def lines(snapshot: DataFrame, sign: int) -> DataFrame:
        kept = maybe_in(snapshot, modified, "path")
        return kept.select("path", F.explode(split_lines(F.col("content"))).alias("line")).select(
            "path", F.xxhash64("line").alias("a"), F.xxhash64("line", F.lit(1)).alias("b"), F.lit(sign).alias("sign"))

    balance = lines(head, 1).unionByName(lines(base, -1)).groupBy("path", "a", "b").agg(F.sum("sign").alias("n"))
    return _counted(paths, balance)


def _counted(paths: DataFrame, balance: DataFrame) -> DataFrame:
    """Modified paths from ``balance(path, ..., n)``: how much more often head has a line than base.

    Left join: a path that is not modified goes, and a file emptied on one side
    and empty of lines on the other has no line at all.
    """
    counted = balance.groupBy("path").agg(
        F.sum(F.greatest("n", F.lit(0))).cast("int").alias("additions"),
        F.sum(F.greatest(-F.col("n"), F.lit(0))).cast("int").alias("deletions"))
    return paths.join(counted, "path", "left").select(
        "path", F.lit(None).cast(paths.schema["path"].dataType).alias("old_path"),
        F.lit("modified").alias("change_type"),
        F.coalesce("additions", F.lit(0)).alias("additions"),
        F.coalesce("deletions", F.lit(0)).alias("deletions"))
