"""The catalogue query: every repository with its latest scan and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcstrata.operators.relational import null_safe_join, top1_per_group


def join_repo_branches(repositories: DataFrame, branches: DataFrame) -> DataFrame:
    """Repositories with their branches; repositories without one are kept.

    Written as an inner join and the repositories left over: the rows of a
    repository with very many branches can then be split over tasks, which an
    outer join does not allow on its right side.
    """
    b = branches.select(F.col("repository_id").alias("id"), F.col("id").alias("branch_id"),
                        F.col("name").alias("branch_name"))
    found = repositories.join(b, "id")
    without = repositories.join(b.select("id").distinct(), "id", "left_anti")
    return found.unionByName(without, allowMissingColumns=True)


def branch_count(repositories: DataFrame, branches: DataFrame) -> DataFrame:
    """Distinct branches per repository, 0 without one."""
    ids = repositories.select(F.col("id").alias("repository_id"))
    return _with_branch_count(ids, branches).withColumnRenamed("repository_id", "id")


def _with_branch_count(rows: DataFrame, branches: DataFrame) -> DataFrame:
    """Counted before the join: the first exchange is on (repository, branch), so
    a repository with very many branches does not make one heavy task.
    """
    counts = branches.groupBy("repository_id").agg(
        F.countDistinct("id").cast("int").alias("branch_count"))
    return rows.join(counts, "repository_id", "left").withColumn(
        "branch_count", F.coalesce("branch_count", F.lit(0)))


def latest_scans(scan_runs: DataFrame) -> DataFrame:
    """Latest scan per repository: by completion, else start; ties by id."""
    return top1_per_group(
        scan_runs, ["repository_id"],
        [F.coalesce("completed_at", "started_at").desc_nulls_first(), F.col("id").desc_nulls_first()])


def latest_scan_per_repo(repositories: DataFrame, scan_runs: DataFrame) -> DataFrame:
    """Every repository id with the columns of its latest scan, or nulls."""
    return _with_latest_scan(repositories.select(F.col("id").alias("repository_id")), scan_runs)


def _with_latest_scan(rows: DataFrame, scan_runs: DataFrame) -> DataFrame:
    latest = latest_scans(scan_runs).select(
        "repository_id", F.col("id").alias("scan_run_id"), "branch_id", "head_commit_sha", "status",
        "started_at", "completed_at")
    return rows.join(latest, "repository_id", "left")


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """Latest metrics per (repository, branch); a null branch is a group of its own.

    (repository, branch, date) is unique with nulls equal, so the date decides.
    """
    return top1_per_group(metrics, ["repository_id", "branch_id"],
                          [F.col("date").desc_nulls_first()]).select(
        "repository_id", "branch_id", "date", "file_count", "class_count", "method_count")


def latest_metrics_per_repo(latest_scan: DataFrame, metrics: DataFrame) -> DataFrame:
    """Latest metrics of the branch last scanned.

    A repository without a scan has a null branch here and matches the metrics
    whose branch is null.
    """
    return null_safe_join(latest_scan, latest_metrics(metrics), ["repository_id", "branch_id"],
                          "left")


def latest_branch_name(latest_scan: DataFrame, branches: DataFrame) -> DataFrame:
    names = branches.select(F.col("id").alias("b_id"), F.col("name").alias("latest_branch"))
    return latest_scan.join(names, latest_scan.branch_id == names.b_id, "left").drop("b_id")


def default_branch_flag(branches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Flags which candidate branches become default.

    ``candidates`` are new branches (repository_id, name, first_seen_at). A
    repository that has a default keeps it; otherwise its first candidate by
    (first_seen_at, name) becomes the default.
    """
    has_default = branches.filter("is_default").select("repository_id").distinct()
    first = top1_per_group(
        candidates.join(has_default, "repository_id", "left_anti"), ["repository_id"],
        [F.col("first_seen_at").asc_nulls_last(), F.col("name").asc_nulls_last()])
    chosen = first.select("repository_id", "name", F.lit(True).alias("chosen"))
    return candidates.join(chosen, ["repository_id", "name"], "left").withColumn(
        "is_default", F.coalesce("chosen", F.lit(False))).drop("chosen")


def repository_summary(repositories: DataFrame, branches: DataFrame, scan_runs: DataFrame,
                       metrics: DataFrame) -> DataFrame:
    """The summary rows, unordered; ``updated_at`` and the scan times are kept for sorting.

    Each side is reduced to one row per repository (or per repository and
    branch) before it is joined, so nothing multiplies, no group-by over the
    joined rows is needed, and the joins on the repository share one exchange.
    """
    r = repositories.select(F.col("id").alias("repository_id"), "name", "url", "updated_at")
    scanned = _with_latest_scan(_with_branch_count(r, branches), scan_runs)
    return latest_metrics_per_repo(latest_branch_name(scanned, branches), metrics)


def summary_projection(summary: DataFrame) -> DataFrame:
    """The twelve output columns, counts defaulting to 0."""
    return summary.select(*_summary_columns())


def _summary_columns():
    return [
        F.col("repository_id").alias("id"), "name", "url", "branch_count", "latest_branch",
        F.col("head_commit_sha").alias("latest_commit_sha"),
        F.col("scan_run_id").alias("latest_scan_run_id"),
        F.col("status").alias("latest_scan_status"),
        F.col("completed_at").alias("last_scanned_at"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("file_count", "class_count", "method_count")],
    ]


def list_repositories(repositories: DataFrame, branches: DataFrame, scan_runs: DataFrame,
                      metrics: DataFrame) -> DataFrame:
    """The whole catalogue, last active first; equal names and times by id."""
    summary = repository_summary(repositories, branches, scan_runs, metrics)
    active = F.coalesce("completed_at", "started_at", "updated_at").alias("__active")
    return (summary.select(*_summary_columns(), active)
            .orderBy(F.col("__active").desc_nulls_first(), F.col("name").asc_nulls_last(), "id")
            .drop("__active"))


def scan_runs_by_status(scan_runs: DataFrame, statuses: list[str] | None = None,
                        started_from=None, started_before=None) -> DataFrame:
    """Scans by status and start time; both predicates reach the Parquet scan."""
    out = scan_runs
    if statuses is not None:
        out = out.filter(F.col("status").isin(statuses))
    if started_from is not None:
        out = out.filter(F.col("started_at") >= F.lit(started_from))
    if started_before is not None:
        out = out.filter(F.col("started_at") < F.lit(started_before))
    return out


def daily_repository_metrics(totals: DataFrame, scanned: DataFrame,
                             keys: Sequence[str] = ("repository_id", "branch_id")) -> DataFrame:
    """Metric rows of a scan: the totals of each scanned branch on its scan date.

    ``scanned`` has (repository_id, branch_id, scan_run_id, scanned_at). A scan
    that found no file still writes a row of zeros.
    """
    joined = null_safe_join(scanned, totals, list(keys), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("file_count", "class_count", "method_count")]
    return joined.select("repository_id", "branch_id", "scan_run_id",
                         F.to_date("scanned_at").alias("date"), *zero,
                         F.lit(0).alias("dependency_count"))
