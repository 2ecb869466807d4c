"""State changes as pure functions ``f(state, batch) -> new state``.

Parquet has no MERGE, so a table is rebuilt as: state rows, updated where the
batch has their key, plus the batch rows whose key is new. A batch is cut to one
row per key, compared with the state's keys once, and stored with the outcome;
the update is then a left join of that small table into the state, the inserts
are its unknown rows. Where the batch is small the planner broadcasts it, and the
state is not shuffled.

A batch may hold a key more than once; the reference applies rows one by one,
so the last row by (event time, id) counts, and for insert-or-ignore the first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcstrata.operators.relational import null_safe_join, top1_per_group
from srcstrata.operators.summary import default_branch_flag
from srcstrata.session import stored


def last_per_key(batch: DataFrame, keys: Sequence[str], event_order: Sequence[str]) -> DataFrame:
    return top1_per_group(batch, keys, [F.col(c).desc_nulls_last() for c in event_order])


def first_per_key(batch: DataFrame, keys: Sequence[str], event_order: Sequence[str]) -> DataFrame:
    return top1_per_group(batch, keys, [F.col(c).asc_nulls_last() for c in event_order])


def last_with_first_time(batch: DataFrame, keys: Sequence[str], first: str) -> DataFrame:
    """The last row of every key by (event_time, event_id), with the first event time as ``first``."""
    values = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.struct("event_time", "event_id")).alias("__last"),
        F.min("event_time").alias(first)).select(*keys, "__last.*", first)


def tagged(state: DataFrame, batch: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """A batch unique on ``keys``, stored, with ``__known``: true where the state has the key, else null."""
    present = null_safe_join(state.select(*keys), batch.select(*keys), keys, "left_semi").distinct()
    return stored(null_safe_join(batch, present.withColumn("__known", F.lit(True)), keys, "left"), f"batch-{name}")


def merge(state: DataFrame, batch: DataFrame, keys: Sequence[str], updates: dict[str, Column],
          inserts: DataFrame | None = None) -> DataFrame:
    """Applies a batch that is unique on ``keys`` (null keys equal).

    ``updates`` maps a state column to its new value in terms of batch columns,
    which the join exposes with the prefix ``new_``. ``inserts`` are the rows
    for new keys in the state's columns; without them only updates happen.
    """
    incoming = batch.select(*keys, *[F.col(c).alias(f"new_{c}") for c in batch.columns
                                     if c not in keys], F.lit(True).alias("__hit"))
    joined = null_safe_join(state, incoming, keys, "left")
    updated = joined.select(*[
        F.when(F.col("__hit"), updates[c]).otherwise(F.col(c)).alias(c) if c in updates else F.col(c)
        for c in state.columns])
    if inserts is None:
        return updated
    return updated.unionByName(inserts.select(*state.columns))


def new_rows(state: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Batch rows whose key the state does not have (null keys equal).

    The state is first cut down to the keys of the batch, so it is not shuffled
    when the batch is small.
    """
    present = null_safe_join(state.select(*keys), batch.select(*keys), keys, "left_semi")
    return null_safe_join(batch, present, keys, "left_anti")


def assign_ids(rows: DataFrame, keys: Sequence[str], used: DataFrame, buckets: int = 1024,
               column: str = "id", bucket: Column | None = None) -> DataFrame:
    """Dense new ids above the largest used one, the same on every evaluation.

    Rows are numbered inside hash buckets of their unique key, or the given
    ones; only the bucket sizes (at most ``buckets`` rows) are summed up in one place.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int") if bucket is None else bucket
    bucketed = rows.withColumn("__bucket", bucket)
    sizes = bucketed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0))
                           .alias("__offset"))
    top = used.agg(F.coalesce(F.max(column), F.lit(0)).alias("top")).scalar()
    within = Window.partitionBy("__bucket").orderBy(*keys)
    return (bucketed.join(offsets, "__bucket")
            .withColumn(column, top + F.col("__offset") + F.row_number().over(within))
            .drop("__bucket", "__offset"))


def upsert_repositories(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Key ``url``: a match takes the name and the time, keeps id and created_at.

    ``batch``: url, name, event_time, event_id. A new row is created at its
    first event, so the state does not depend on how events are cut into batches.
    """
    rows = tagged(state, last_with_first_time(batch, ["url"], "created_at"), ["url"], "repositories")
    fresh = assign_ids(rows.filter("__known IS NULL"), ["url"], state).withColumn("updated_at", F.col("event_time"))
    return merge(state, rows.filter("__known"), ["url"],
                 {"name": F.col("new_name"), "updated_at": F.col("new_event_time")}, fresh)


def upsert_commits(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Key (repository_id, sha): a match takes author, message and commit time.

    ``batch``: repository_id, sha, author_name, author_email, message,
    committed_at, event_time, event_id. ``discovered_at`` stays the first.
    """
    keys = ["repository_id", "sha"]
    rows = tagged(state, last_with_first_time(batch, keys, "discovered_at"), keys, "commits")
    fresh = assign_ids(rows.filter("__known IS NULL"), keys, state)
    changed = ["author_name", "author_email", "message", "committed_at"]
    return merge(state, rows.filter("__known"), keys, {c: F.col(f"new_{c}") for c in changed}, fresh)


def upsert_branches(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Key (repository_id, name): a match takes both commit ids, never is_default.

    ``batch``: repository_id, name, head_commit_sha, event_time, event_id. A new
    branch becomes the default only where its repository has none.
    """
    keys = ["repository_id", "name"]
    rows = tagged(state, last_with_first_time(batch, keys, "first_seen_at"), keys, "branches")
    fresh = assign_ids(default_branch_flag(state, rows.filter("__known IS NULL")), keys, state)
    fresh = fresh.select(
        "id", *keys, "is_default", F.col("head_commit_sha").alias("last_seen_commit_sha"),
        F.col("head_commit_sha").alias("last_scanned_commit_sha"),
        F.col("first_seen_at").alias("created_at"), F.col("event_time").alias("updated_at"))
    return merge(state, rows.filter("__known"), keys, {
        "last_seen_commit_sha": F.col("new_head_commit_sha"),
        "last_scanned_commit_sha": F.col("new_head_commit_sha"),
        "updated_at": F.col("new_event_time"),
    }, fresh)


def link_branch_commits(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Key (branch_id, commit_id): the first link wins, a later one changes nothing.

    ``batch``: repository_id, branch_id, commit_id, first_seen_at.
    """
    keys = ["branch_id", "commit_id"]
    first = first_per_key(batch, keys, ["first_seen_at", "repository_id"])
    fresh = assign_ids(tagged(state, first, keys, "branch-commits").filter("__known IS NULL"), keys, state)
    return state.unionByName(fresh.select(*state.columns))


def upsert_daily_metrics(state: DataFrame, batch: DataFrame,
                         event_order: Sequence[str] = ("scan_run_id",)) -> DataFrame:
    """Key (repository_id, branch_id, date), null branches equal; the last row wins."""
    keys = ["repository_id", "branch_id", "date"]
    latest = last_per_key(batch, keys, list(event_order))
    rows = tagged(state, latest, keys, "daily-metrics")
    changed = [c for c in state.columns if c not in keys]
    return merge(state, rows.filter("__known"), keys, {c: F.col(f"new_{c}") for c in changed},
                 rows.filter("__known IS NULL"))


def replace_branch_files(state: DataFrame, batch: DataFrame, scanned: DataFrame) -> DataFrame:
    """Drops all rows of every scanned (repository_id, branch_id) and adds the batch.

    The scan list decides, not the batch, so a branch scanned empty is cleared.
    Works for files, classes and methods alike.
    """
    keys = ["repository_id", "branch_id"]
    kept = null_safe_join(state, scanned.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(batch.select(*state.columns))


def start_scan_runs(state: DataFrame, started: DataFrame) -> DataFrame:
    """Adds running scans; a scan id already known is a replay and changes nothing.

    ``started``: id, repository_id, branch_id, head_commit_sha, trigger_type, started_at,
    and base_commit_sha where it is known.
    """
    rows = first_per_key(started, ["id"], ["started_at"])
    base = F.col("base_commit_sha") if "base_commit_sha" in started.columns else F.lit(None).cast("string")
    rows = rows.withColumns({
        "status": F.lit("running"), "base_commit_sha": base,
        "completed_at": F.lit(None).cast(state.schema["completed_at"].dataType),
        "error_message": F.lit(None).cast("string")})
    return state.unionByName(new_rows(state, rows, ["id"]).select(*state.columns))


def complete_scan_runs(state: DataFrame, finished: DataFrame) -> DataFrame:
    """Closes scans by id with their time, and a status ``failed`` where an error came.

    ``finished``: id, completed_at, error_message.
    """
    last = last_per_key(finished, ["id"], ["completed_at", "error_message"])
    return merge(state, last, ["id"], {
        "status": F.when(F.col("new_error_message").isNull(), "completed").otherwise("failed"),
        "completed_at": F.col("new_completed_at"),
        "error_message": F.col("new_error_message"),
    })
