"""One scan of many repositories, from checked-out trees to catalogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcstrata.functions import language as L
from srcstrata.functions import text as X
from srcstrata.operators import diff, state, summary, symbols
from srcstrata.operators.bitmap import bitmap, flagged
from srcstrata.operators.relational import null_safe_join
from srcstrata.schemas import FILE_KEY
from srcstrata.session import stored
from srcstrata.sources.listings import load_commit_metadata
from srcstrata.sources.source_tree import UNREADABLE

# One row per checked-out repository; scan_run_id is the caller's and unique.
MANIFEST_COLUMNS = ["root", "url", "origin_url", "name", "branch_name", "head_commit_sha",
                    "author_name", "author_email", "message", "committed_at", "scan_run_id",
                    "trigger_type", "scanned_at"]


def source_candidates(files: DataFrame) -> DataFrame:
    """Files worth parsing: not in a skipped folder, of a known language, within the cap."""
    return (files.filter(~L.is_skipped(F.col("path")))
            .withColumn("language", L.detect_language(F.col("path")))
            .filter(F.col("language").isNotNull() & L.within_size_cap(F.col("size"))))


def dropped_files(files: DataFrame) -> DataFrame:
    """(root, path, size, reason) of the entries that are not parsed.

    ``files`` are the entries of a listing with their reasons, or files alone.
    """
    reason = (F.when(L.is_skipped(F.col("path")), "skipped folder")
              .when(L.detect_language(F.col("path")).isNull(), "unknown language")
              .when(~F.coalesce(L.within_size_cap(F.col("size")), F.lit(False)), "size"))
    if "reason" in files.columns:
        reason = F.coalesce(F.col("reason"), reason)
    return files.select("root", "path", "size", reason.alias("reason")).filter("reason IS NOT NULL")


def checked_manifest(manifest: DataFrame) -> DataFrame:
    """Manifest rows with names, URLs and branches filled in, and ``problem`` where a row cannot be scanned.

    A row needs head commit metadata that can be read (``sources.listings``), and
    its explicit URL, where it has one, has to be a repository URL.
    """
    url = F.col("url")
    problem = F.when(X.has_text(url) & X.url_problem(url).isNotNull(), F.concat(F.lit("url: "), X.url_problem(url))
                     ).otherwise(F.col("problem"))
    return load_commit_metadata(manifest.select(*MANIFEST_COLUMNS)).withColumns({
        "problem": problem,
        "name": X.first_non_blank(F.col("name"), X.derive_repository_name(
            url, X.file_name(F.rtrim("root", F.lit("/"))))),
        "url": X.canonical_repository_url(url, F.col("origin_url"), X.file_uri(F.col("root"))),
    }).withColumnsRenamed({"scanned_at": "event_time", "scan_run_id": "event_id"})


# A file of a branch as it was last parsed; what an incremental scan compares with and takes over.
INDEX_SCHEMA = ("repository_id long, branch_id long, path string, language string, sha string, loc int, "
                "class_names array<string>, method_names array<string>, line_hashes array<bigint>")
_INDEX = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]


def scan_repositories(tables: dict[str, DataFrame], manifest: DataFrame, files: DataFrame
                      ) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables after the scan, one result row per manifest row).

    ``files`` (root, path, size, content) are the trees of the manifest's roots;
    with a column ``reason`` they are all entries of a listing, and those with a
    reason have no content. Texts are read once: what is kept of them is stored
    before it is used.

    A row with a problem is reported as ``rejected`` and changes nothing. A scan
    with an unreadable root or folder, or an unreadable or malformed file, is
    ``failed`` with a message; the files, symbols and metrics of its branch stay
    as they were. Of several scans of a
    branch the last completed one gives its files; each has its scan row and
    counts towards the metrics of its day.
    """
    return _scan(tables, manifest, files, None)[:2]


def scan_incrementally(tables: dict[str, DataFrame], index: DataFrame, manifest: DataFrame, files: DataFrame
                       ) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(tables after the scan, report, index after the scan): :func:`scan_repositories` that parses changed files only.

    ``index`` (``INDEX_SCHEMA``) holds the files of every branch with the hash of
    their content and what was parsed of them. A file that the index has with
    this content is not parsed again; the tables are those of a full scan. A
    scan of a branch that was scanned before names the commit it started from as
    ``base_commit_sha``, and its differences are added to ``file_changes``. The
    report counts the parsed files.

    Contents are read and hashed once and never shuffled: a bounded bitmap of the
    index tells which files are surely new and parses them in place; what it
    takes for known is looked up by key and hash, and parsed after all if it is not.
    """
    return _scan(tables, manifest, files, index)


def _parsed(texts: DataFrame) -> DataFrame:
    lines = symbols.decode_source(texts)
    return symbols.match_symbols(lines.withColumn("line_hashes", F.transform("lines", lambda x: F.xxhash64(x))))


def _parsed_or_known(texts: DataFrame, index: DataFrame) -> DataFrame:
    """Matched files as the index has them or as they are parsed now; ``parsed`` says which."""
    key = [*FILE_KEY, "sha"]
    hashed = texts.withColumn("sha", F.sha2("content", 256))
    marked = flagged(hashed, bitmap(index, *key), "known", *key)
    probe = stored(_parsed(marked.withColumn("content", F.when(~F.col("known"), F.col("content")))), "probe")
    found = ["loc", "class_names", "method_names", "line_hashes"]
    fresh = probe.filter("NOT known").drop("known").withColumn("parsed", F.lit(True))
    maybe = probe.filter("known").drop("known", *found)
    known = null_safe_join(maybe, index.select(*key, *found), key, "inner").withColumn("parsed", F.lit(False))
    # What only the bitmap takes for known.
    missed = null_safe_join(maybe, index.select(*key), key, "left_anti").select("scan_run_id", "path")
    again = _parsed(hashed.join(missed, ["scan_run_id", "path"], "left_semi")).withColumn("parsed", F.lit(True))
    return fresh.unionByName(known).unionByName(again.select(*fresh.columns))


def _scan(tables: dict[str, DataFrame], manifest: DataFrame, files: DataFrame, index: DataFrame | None):
    out = dict(tables)
    checked = stored(checked_manifest(manifest), "checked")
    rejected = checked.filter("problem IS NOT NULL")
    m = checked.filter("problem IS NULL").drop("problem")

    out["repositories"] = stored(state.upsert_repositories(
        tables["repositories"], m.select("url", "name", "event_time", "event_id")), "repositories")
    m = m.join(out["repositories"].select("url", F.col("id").alias("repository_id")), "url")

    out["commits"] = stored(state.upsert_commits(tables["commits"], m.withColumnRenamed(
        "head_commit_sha", "sha").select(
        "repository_id", "sha", "author_name", "author_email", "message",
        "committed_at", "event_time", "event_id")), "commits")
    out["branches"] = stored(state.upsert_branches(tables["branches"], m.select(
        "repository_id", F.col("branch_name").alias("name"), "head_commit_sha", "event_time",
        "event_id")), "branches")
    m = (m.join(out["branches"].select("repository_id", F.col("name").alias("branch_name"),
                                       F.col("id").alias("branch_id")),
                ["repository_id", "branch_name"])
         .join(out["commits"].select("repository_id", F.col("sha").alias("head_commit_sha"),
                                     F.col("id").alias("commit_id")),
               ["repository_id", "head_commit_sha"]))
    if index is not None:
        scanned_before = tables["branches"].select(F.col("id").alias("branch_id"), F.col("last_scanned_commit_sha").alias(
            "base_commit_sha"))
        m = m.join(scanned_before, "branch_id", "left")
    m = stored(m, "manifest")
    out["branch_commits"] = state.link_branch_commits(tables["branch_commits"], m.select(
        "repository_id", "branch_id", "commit_id", F.col("event_time").alias("first_seen_at")))

    scans = m.select("root", "repository_id", "branch_id", F.col("event_id").alias("scan_run_id"))
    readable = F.coalesce(F.is_valid_utf8("content"), F.lit(False))
    unseen = None
    if "reason" in files.columns:
        unseen = files.filter(F.col("reason").isin(UNREADABLE)).select("root", F.concat_ws(
            ": ", "reason", F.nullif(F.col("path"), F.lit(""))).alias("error_message"))
        files = files.filter("reason IS NULL").drop("reason")
    texts = (source_candidates(files).join(scans, "root").drop("root", "size")
             .withColumn("readable", readable)
             .withColumn("content", F.when(F.col("readable"), F.col("content")).otherwise(F.lit(b""))))
    if index is None:
        matched = stored(symbols.match_symbols(symbols.decode_source(texts)), "matched")
    else:
        matched = stored(_parsed_or_known(texts, index), "matched")
    failed = matched.filter("NOT readable").select("scan_run_id", F.concat(
        F.lit("unreadable or not UTF-8: "), "path").alias("error_message"))
    if unseen is not None:
        failed = failed.unionByName(unseen.join(scans, "root").select("scan_run_id", "error_message"))
    failed = failed.groupBy(F.col("scan_run_id").alias("event_id")).agg(F.min("error_message").alias("error_message"))
    m = stored(m.join(failed, "event_id", "left"), "scans")

    started = state.start_scan_runs(tables["scan_runs"], m.select(
        F.col("event_id").alias("id"), "repository_id", "branch_id", "head_commit_sha",
        "trigger_type", F.col("event_time").alias("started_at"), *([] if index is None else ["base_commit_sha"])))
    out["scan_runs"] = state.complete_scan_runs(started, m.select(
        F.col("event_id").alias("id"), F.col("event_time").alias("completed_at"), "error_message"))

    completed = m.filter("error_message IS NULL").select(
        "repository_id", "branch_id", F.col("event_id").alias("scan_run_id"),
        F.col("event_time").alias("scanned_at"))
    last = stored(state.last_per_key(completed, ["repository_id", "branch_id"], ["scanned_at", "scan_run_id"]),
                  "last-scans")
    current = matched.join(last.select("scan_run_id"), "scan_run_id", "left_semi")
    found = stored(symbols.file_symbols(current), "symbols")
    for name, rows in (("source_files", symbols.file_rows(current, F.col("scan_run_id"))),
                       ("classes", symbols.class_rows(found)),
                       ("methods", symbols.method_rows(found))):
        out[name] = state.replace_branch_files(tables[name], rows, last)

    by_scan = ["repository_id", "branch_id", "scan_run_id"]
    daily = summary.daily_repository_metrics(symbols.scan_totals(matched, by_scan), completed, by_scan)
    out["repository_metrics"] = state.upsert_daily_metrics(tables["repository_metrics"], daily)
    report = _report(m, daily, rejected)
    if index is None:
        return out, report, None
    head = stored(current.select(*_INDEX), "index")
    based = last.join(m.filter("base_commit_sha IS NOT NULL").select(F.col("event_id").alias("scan_run_id")),
                      "scan_run_id", "left_semi").select("repository_id", "branch_id", "scan_run_id")
    trees = ["repository_id", "branch_id"]
    changes = diff.index_changes(null_safe_join(index, based.select(*trees), trees, "left_semi"),
                                 null_safe_join(head, based.select(*trees), trees, "left_semi"), trees)
    changes = null_safe_join(changes, based, trees, "inner").withColumn("patch_uri", F.lit(None).cast("string"))
    out["file_changes"] = tables["file_changes"].unionByName(changes.select(*tables["file_changes"].columns))
    parsed = matched.groupBy("scan_run_id").agg(F.count_if("parsed").cast("int").alias("parsed_files"))
    return out, report.join(parsed, "scan_run_id", "left"), state.replace_branch_files(index, head, last)


def _report(m: DataFrame, daily: DataFrame, rejected: DataFrame) -> DataFrame:
    keys = ["repository_id", "branch_id", "scan_run_id"]
    counts = daily.select(*keys, "file_count", "class_count", "method_count")
    named = m.select("repository_id", "branch_id", F.col("event_id").alias("scan_run_id"), "name",
                     F.col("branch_name").alias("branch"), "head_commit_sha",
                     F.when(F.col("error_message").isNull(), "completed").otherwise("failed").alias("status"),
                     "error_message")
    refused = rejected.select(F.col("event_id").alias("scan_run_id"), "name", F.col("branch_name").alias("branch"),
                              "head_commit_sha", F.lit("rejected").alias("status"),
                              F.col("problem").alias("error_message"))
    return null_safe_join(named, counts, keys, "left").unionByName(refused, allowMissingColumns=True)
