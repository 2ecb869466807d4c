"""Branch listings and head-commit manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcstrata.functions.text import has_text, instant, strip

# --- fixed value: prefix of a branch reference -------------------------------
BRANCH_LINE = r"(?s)\A(\S+)\s+refs/heads/(.*)\z"


def parse_branch_listing(lines: DataFrame, column: str = "line", strict: bool = False) -> DataFrame:
    """``name, commit_sha, is_valid`` of ``<sha> refs/heads/<name>`` lines; blanks are dropped.

    A line of any other form fails the job in strict mode and is kept with
    ``is_valid = false`` otherwise, for :func:`rejected_lines`.
    """
    text = strip(F.col(column))
    rows = lines.filter(has_text(F.col(column))).withColumn("is_valid", text.rlike(BRANCH_LINE))

    def group(i: int):
        found = F.regexp_extract(text, BRANCH_LINE, i)
        if strict:
            return F.when(F.col("is_valid"), found).otherwise(F.raise_error(
                F.concat(F.lit("unexpected branch line: "), text)))
        return F.when(F.col("is_valid"), found)

    return rows.withColumns({"name": group(2), "commit_sha": group(1)})


def rejected_lines(parsed: DataFrame) -> DataFrame:
    return parsed.filter(~F.col("is_valid"))


COMMIT_COLUMNS = ["branch_name", "head_commit_sha", "author_name", "author_email", "message", "committed_at"]


def load_commit_metadata(manifest: DataFrame) -> DataFrame:
    """Head commits of a manifest: its columns, the six of the commit read, and ``problem``.

    A detached head, or no branch name, is the branch ``HEAD``, as git reports it. Names are
    stripped, blank ones are null; the message stays as it is. A row without a
    commit id, or with a time that is no ISO-8601 time, has a problem and is
    never dropped here; :func:`rejected_commits` lists such rows.
    """
    sha, time = strip(F.col("head_commit_sha")), F.col("committed_at")
    parsed = instant(F.col("committed_at"))
    no_time = F.coalesce(has_text(time.cast("string")), F.lit(False)) & parsed.isNull()
    problem = (F.when(~F.coalesce(has_text(sha), F.lit(False)), "no commit id")
               .when(no_time, F.concat(F.lit("time: "), time.cast("string"))))

    def named(column: str):
        return F.when(has_text(F.col(column)), strip(F.col(column)))
    return manifest.withColumn("problem", problem).withColumns({
        "branch_name": F.coalesce(named("branch_name"), F.lit("HEAD")), "head_commit_sha": sha,
        "author_name": named("author_name"), "author_email": named("author_email"), "committed_at": parsed})


def rejected_commits(loaded: DataFrame) -> DataFrame:
    return loaded.filter("problem IS NOT NULL")
