"""One query per operator, each over whole tables of a :class:`Catalogue`."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcstrata.functions import language as L
from srcstrata.functions import text as X
from srcstrata.operators import cascade, diff, quality, search, state, summary, symbols
from srcstrata.operators.relational import null_safe_join
from srcstrata.plans import scan
from srcstrata.plans.adapters import CUT, Catalogue, daily_metrics
from srcstrata.schemas import FILE_KEY, TABLES
from srcstrata.session import shared_folder, stored
from srcstrata.sources import listings, source_tree, tables
from srcstrata.sources.versions import VersionedTables
from srcstrata.streaming import scan_events, scan_state

QUERIES: dict[str, Callable[[Catalogue], DataFrame]] = {}

# Texts at least this short pass the size cap query; no given text reaches 1 MB.
SIZE_CAP = 2_000
# Column limits lowered far enough for some rows to break them.
LOWER_LIMITS = {"repositories": {"name": 17, "url": 50}, "classes": {"name": 8},
                "methods": {"name": 8}, "analysis_artifacts": {"artifact_type": 8},
                "technical_debt": {"severity": 8}, "commits": {"message": 18}}
PREFIX = "Th"
TOP_K = 5


def query(fn: Callable[[Catalogue], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _naive(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


# --- scans, sources, sinks ------------------------------------------------------

@query
def source_tree_scan(c: Catalogue) -> DataFrame:
    root = shared_folder(c.spark, "tree")
    texts = c.raw("documents").select("doc_id", F.col("text").alias("content"))
    source_tree.export_tree(c.paths.join(texts, "doc_id"), root)
    return source_tree.read_tree(c.spark, root).select("path", "size", F.md5("content").alias("digest"))


@query
def skip_generated_dirs(c):
    return c.paths.filter(~L.is_skipped(F.col("path")))


@query
def source_size_cap(c):
    sized = c.raw("documents").select("doc_id", F.octet_length("text").alias("size"))
    return sized.filter(L.within_size_cap(F.col("size"), SIZE_CAP))


@query
def source_decode_lines(c):
    stored = c.file_contents.withColumn("content", F.encode("content", "UTF-8"))
    return symbols.file_lines(symbols.decode_source(stored)).select("path", "line_no", "line")


@query
def read_repository_tables(c):
    folder = shared_folder(c.spark, "tables")
    names = ["repositories", "branches", "scan_runs", "repository_metrics"]
    for name in names:
        table = TABLES[name]
        rows = getattr(c, name).select(*[F.col(f.name).cast(f.dataType) for f in table.schema])
        rows.write.parquet(f"{folder}/{name}")
    read = tables.read_tables(c.spark, folder, names)
    return _naive(summary.list_repositories(*read.values()), "last_scanned_at")


@query
def branch_listing_parse(c):
    return listings.parse_branch_listing(c.branch_lines).select(
        "c_custkey", "name", "commit_sha", "is_valid")


@query
def commit_metadata_load(c):
    return _naive(listings.load_commit_metadata(c.manifest), "committed_at").select(
        "page_id", *listings.COMMIT_COLUMNS, "problem")


@query
def write_scan_snapshot(c):
    store = VersionedTables(c.spark, shared_folder(c.spark, "snapshot"))
    old, new, scanned = _rescan(c)
    store.commit({"source_files": store.replace(old)})
    store.replace_branches({"source_files": new}, scanned)
    return store.read("source_files")


@query
def read_scan_version(c):
    """A branch's files before and after the rescan, from two versions of the same store."""
    store = VersionedTables(c.spark, shared_folder(c.spark, "versions"))
    old, new, scanned = _rescan(c)
    first = store.commit({"source_files": store.replace(old)})
    second = store.replace_branches({"source_files": new}, scanned)

    def sums(version: int) -> DataFrame:
        return store.read("source_files", version).groupBy("repository_id", "branch_id").agg(
            F.lit(version).cast("long").alias("version"), F.count("*").alias("n_files"), F.sum("loc").alias("loc"))
    return sums(first).unionByName(sums(second))


# --- projections, filters, predicates ----------------------------------------------

@query
def detect_language(c):
    return c.paths.withColumn("language", L.detect_language(F.col("path"))).filter(
        "language IS NOT NULL")


@query
def control_keyword_filter(c):
    found = c.lines.select("path", symbols.call_like_matches(
        F.col("language"), F.col("lines")).alias("names"))
    return found.select("path", F.size(symbols.without_control_keywords(F.col("names"))).alias("kept"),
                        F.size("names").alias("matches"))


@query
def repo_url_validation(c):
    problem = X.url_problem(F.col("repo_url"))
    return c.manifest.select("page_id", "repo_url", problem.isNull().alias("is_valid"),
                             problem.alias("reason"))


@query
def null_safe_match(c):
    latest = summary.latest_scan_per_repo(c.repositories, c.scan_runs).select(
        "repository_id", "branch_id")
    per_branch = c.repository_metrics.groupBy("repository_id", "branch_id").agg(
        F.count("*").alias("days"))
    return null_safe_join(latest, per_branch, ["repository_id", "branch_id"], "inner")


@query
def summary_projection(c):
    return summary.summary_projection(summary.repository_summary(
        c.repositories, c.branches, c.scan_runs, c.repository_metrics))


@query
def scan_runs_by_status(c):
    return summary.scan_runs_by_status(
        c.scan_runs, ["completed", "running"],
        F.lit(CUT).cast("timestamp_ntz")).select("id", "repository_id", "status", "started_at")


# --- scalar rules ---------------------------------------------------------------------

@query
def first_non_blank(c):
    return c.manifest.select("page_id", X.first_non_blank(
        F.col("repo_name"), F.col("repo_url")).alias("name"))


@query
def derive_repository_name(c):
    return c.manifest.select("page_id", X.derive_repository_name(
        F.col("repo_url"), F.lit("repository")).alias("name"))


@query
def safe_path_segment(c):
    return c.manifest.select("page_id", X.safe_path_segment(F.col("root_path")).alias("segment"))


@query
def repository_key(c):
    return c.manifest.select("page_id", X.repository_key(F.col("repo_url")).alias("key"))


@query
def line_has_text(c):
    return symbols.file_lines(c.lines).select("path", "line_no", X.has_text(F.col("line")).alias("has_text"))


@query
def fallback_class_name(c):
    return c.paths.select("doc_id", X.fallback_class_name(F.col("path")).alias("class_name"))


@query
def relative_path(c):
    full = F.concat(F.lit("\\data\\repo/"), F.when(F.col("doc_id") % 2 == 0, F.col("path"))
                    .otherwise(F.replace(F.col("path"), F.lit("/"), F.lit("\\"))))
    return c.paths.select("doc_id", X.relative_path(F.lit("/data/repo/"), full).alias("path"))


@query
def canonical_repository_url(c):
    return c.manifest.select("page_id", X.canonical_repository_url(
        F.col("repo_url"), F.col("origin_url"), X.file_uri(F.col("root_path"))).alias("url"))


@query
def timestamp_cast(c):
    return _naive(c.manifest.select("page_id", X.instant(F.col("committed_at")).alias("committed_at")),
                  "committed_at")


@query
def short_commit(c):
    return c.scan_runs.select("id", X.short_commit(F.col("head_commit_sha")).alias("short_sha"))


# --- symbols ------------------------------------------------------------------------------

@query
def extract_classes(c):
    return symbols.raw_symbols(c.matched, "class_names").select("path", "seq", "raw_name")


@query
def extract_methods(c):
    return symbols.raw_symbols(c.matched, "method_names").select("path", "seq", "raw_name")


@query
def unique_symbol_names(c):
    matched = stored(c.matched, "matched")
    classes = symbols.unique_names(symbols.raw_symbols(matched, "class_names"))
    methods = symbols.unique_names(symbols.raw_symbols(matched, "method_names"))
    return classes.select("path", F.lit("class").alias("kind"), "seq", "name").unionByName(
        methods.select("path", F.lit("method").alias("kind"), "seq", "name"))


@query
def attach_methods_to_class(c):
    return c.methods.select("repository_id", "branch_id", "path", "class_name", "name")


@query
def class_rows(c):
    return c.classes


@query
def flatten_parse_tree(c):
    trees = stored(symbols.parse_tree(stored(c.matched, "matched")), "trees")
    files, classes, methods = symbols.flatten_parse_tree(trees)
    none = F.lit(None).cast("string")
    return (files.select(F.lit("file").alias("kind"), "path", none.alias("parent"),
                         F.col("language").alias("name"), "loc", F.lit(0).alias("n"))
            .unionByName(classes.select(F.lit("class").alias("kind"), "path", none.alias("parent"),
                                        "name", "loc", F.col("method_count").alias("n")))
            .unionByName(methods.select(F.lit("method").alias("kind"), "path",
                                        F.col("class_name").alias("parent"), "name", "loc",
                                        F.col("complexity").alias("n"))))


# --- joins ----------------------------------------------------------------------------------

@query
def join_repo_branches(c):
    return summary.join_repo_branches(c.repositories, c.branches).select(
        "id", "url", "branch_id", "branch_name")


@query
def latest_scan_per_repo(c):
    return summary.latest_scan_per_repo(c.repositories, c.scan_runs)


@query
def latest_metrics_per_repo(c):
    latest = summary.latest_scan_per_repo(c.repositories, c.scan_runs).select(
        "repository_id", "branch_id", "scan_run_id")
    return summary.latest_metrics_per_repo(latest, c.repository_metrics).withColumn(
        "date", F.col("date").cast("string"))


@query
def latest_branch_name(c):
    latest = summary.latest_scan_per_repo(c.repositories, c.scan_runs).select(
        "repository_id", "scan_run_id", "branch_id")
    return summary.latest_branch_name(latest, c.branches)


@query
def default_branch_flag(c):
    known, candidates = c.split(c.branches, "created_at")
    # A repository known before keeps its default, if one of its known branches is it.
    candidates = candidates.select("repository_id", "name", F.col("created_at").alias("first_seen_at"))
    return summary.default_branch_flag(known, candidates)


@query
def file_class_method_join(c):
    t = c.tables("source_files", "classes", "methods")
    return symbols.file_class_method_join(t["source_files"], t["classes"], t["methods"])


@query
def orphan_rows(c):
    deleted, _ = _without_parents(c)
    return quality.orphan_rows(c.scan_runs, deleted["branches"], ["repository_id", "branch_id"],
                               ["repository_id", "id"]).select("id", "repository_id", "branch_id")


def _without_parents(c: Catalogue):
    """Repositories and branches after a delete that forgot the children."""
    kept = {"repositories": c.repositories, "branches": c.branches}
    return cascade.delete_repositories(kept, c.delete_ids)


# --- aggregations ------------------------------------------------------------------------------

@query
def branch_count(c):
    return summary.branch_count(c.repositories, c.branches)


@query
def repository_summary_grouping(c):
    full = summary.repository_summary(c.repositories, c.branches, c.scan_runs, c.repository_metrics)
    return full.select("repository_id", "name", "url", "updated_at", "latest_branch", "scan_run_id",
                       "head_commit_sha", "status", "started_at", "completed_at", "file_count",
                       "class_count", "method_count", "branch_count")


@query
def file_loc(c):
    return c.lines.select(*FILE_KEY, symbols.line_count(F.col("lines")).alias("loc"))


@query
def scan_totals(c):
    return symbols.scan_totals(c.matched)


@query
def daily_repository_metrics(c):
    scanned = c.newest_scans.select("repository_id", "branch_id", F.col("id").alias("scan_run_id"),
                                    F.col("started_at").alias("scanned_at"))
    return summary.daily_repository_metrics(symbols.scan_totals(c.matched), scanned).withColumn(
        "date", F.col("date").cast("string"))


@query
def text_length_check(c):
    return quality.text_length_check(c.tables(), LOWER_LIMITS)


# --- sorts, limits ---------------------------------------------------------------------------

@query
def list_repositories(c):
    return summary.list_repositories(c.repositories, c.branches, c.scan_runs, c.repository_metrics)


@query
def top1_per_group_(c):
    return c.newest_scans.select("repository_id", "branch_id", "id", "started_at")


QUERIES["top1_per_group"] = QUERIES.pop("top1_per_group_")


# --- state changes ----------------------------------------------------------------------------------

@query
def upsert_repositories(c):
    known = c.repositories.join(c.raw("customer").selectExpr("c_custkey * 2 as id"), "id", "left_semi")
    renamed = c.raw("orders").selectExpr("o_custkey * 2 as id", "o_orderkey as event_id",
                                         "o_orderdate as event_time", "o_orderpriority as tag")
    supplied = c.raw("lineitem").selectExpr(
        "l_suppkey * 2 + 1 as id", "l_orderkey * 1000 + l_linenumber as event_id",
        "l_shipdate as event_time", "l_returnflag as tag")
    events = renamed.unionByName(supplied)
    urls = c.repositories.select("id", "url", "name")
    before, since = c.split(events.join(urls, "id").select(
        "url", F.concat("name", F.lit("-"), "tag").alias("name"), "event_time", "event_id"))
    known = stored(state.upsert_repositories(known, before), "repositories")
    return state.upsert_repositories(known, since).select("url", "name", "created_at", "updated_at")


def _commit_events(c: Catalogue) -> DataFrame:
    return c.shipments.select(
        "repository_id", "sha", "author_name",
        F.concat(F.lower("name"), F.lit("@example.org")).alias("author_email"),
        F.concat(F.lit("shipment "), F.col("event_id")).alias("message"),
        F.col("event_time").alias("committed_at"), "event_time", "event_id")


@query
def upsert_commits(c):
    before, since = c.split(_commit_events(c))
    known = stored(state.upsert_commits(c.empty("commits"), before), "commits")
    return state.upsert_commits(known, since).drop("id")


def _branch_events(c: Catalogue) -> DataFrame:
    return c.raw("orders").selectExpr(
        "o_custkey * 2 as repository_id", "o_orderpriority as name",
        "md5(cast(o_orderkey as string)) as head_commit_sha", "o_orderdate as event_time",
        "o_orderkey as event_id")


@query
def upsert_branches(c):
    before, since = c.split(_branch_events(c))
    known = stored(state.upsert_branches(c.empty("branches"), before), "branches")
    return state.upsert_branches(known, since).drop("id")


@query
def link_branch_commits(c):
    links = c.shipments.select("repository_id", "branch_id", "commit_id",
                               F.col("event_time").alias("first_seen_at"))
    before, since = c.split(links, "first_seen_at")
    known = stored(state.link_branch_commits(c.empty("branch_commits"), before), "branch_commits")
    return state.link_branch_commits(known, since).drop("id")


@query
def upsert_daily_metrics(c):
    closed = daily_metrics(c.supplier_lines.filter("l_linestatus = 'F'"))
    opened = daily_metrics(c.supplier_lines.filter("l_linestatus = 'O'"))
    return state.upsert_daily_metrics(closed, opened).withColumn("date", F.col("date").cast("string"))


def _rescan(c: Catalogue) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored files, rescanned files, scan list.

    Every branch that holds documents is scanned again, those of web pages are
    not. Files grew by a line, toxic ones are gone, and repositories in debt
    turn out empty.
    """
    old = stored(c.source_files, "files")
    scanned = old.filter("path like 'src/%'").select("repository_id", "branch_id").distinct()
    toxic = c.raw("labels").filter("toxic = 1").select(F.col("doc_id").alias("scan_run_id"))
    new = (null_safe_join(old, scanned, ["repository_id", "branch_id"], "left_semi")
           .join(c.delete_ids.withColumnRenamed("id", "repository_id"), "repository_id", "left_anti")
           .join(toxic, "scan_run_id", "left_anti")
           .withColumn("loc", F.col("loc") + 1).select(*old.columns))
    return old, new, scanned


@query
def replace_branch_files(c):
    return state.replace_branch_files(*_rescan(c))


@query
def complete_scan_runs(c):
    started = c.raw("orders").selectExpr(
        "o_orderkey as id", "o_custkey * 2 as repository_id",
        "o_custkey * 20 + cast(substr(o_orderpriority, 1, 1) as int) as branch_id",
        "md5(cast(o_orderkey as string)) as head_commit_sha", "'manual' as trigger_type",
        "o_orderdate as started_at")
    finished = c.raw("lineitem").selectExpr(
        "l_orderkey as id", "l_shipdate as completed_at",
        "case when l_returnflag = 'R' then concat('line ', l_linenumber, ' returned') end "
        "as error_message")
    running = state.start_scan_runs(c.empty("scan_runs"), started)
    return state.complete_scan_runs(running, finished)


def _row_keys(tables_: dict[str, DataFrame], *extra: str) -> DataFrame:
    parts = [df.select(F.lit(name).alias("table_name"),
                       quality.key_text(TABLES[name].key).alias("key"),
                       *[F.col(e) if e in df.columns else F.lit(None).cast("long").alias(e)
                         for e in extra])
             for name, df in tables_.items()]
    return reduce(DataFrame.unionByName, parts)


@query
def delete_repository_cascade(c):
    left, unknown = cascade.delete_repositories(c.tables(), c.delete_ids)
    return _row_keys(left).unionByName(unknown.select(
        F.lit("unknown_id").alias("table_name"), F.col("id").cast("string").alias("key")))


@query
def delete_branch_set_null(c):
    ids = c.branches.filter("name = '2-HIGH'").select("id")
    left, _ = cascade.delete_branches(c.tables(), ids)
    return _row_keys(left, "branch_id", "scan_run_id")


# --- data quality ---------------------------------------------------------------------------------

@query
def check_constraints(c):
    return quality.check_constraints(c.tables()).drop("detail")


@query
def unique_violations(c):
    return quality.unique_violations(c.tables())


@query
def one_default_branch(c):
    return quality.one_default_branch(c.branches)


@query
def foreign_key_violations(c):
    return quality.foreign_key_violations(c.tables())


@query
def not_null_violations(c):
    named = c.manifest.selectExpr(
        "page_id as id", "repo_name as name", "repo_url as url",
        "timestamp_ntz'1995-01-01 00:00:00' as created_at",
        "cast(null as timestamp_ntz) as updated_at")
    return quality.not_null_violations({**c.tables(), "repositories": named}).drop("detail")


@query
def domain_violations(c):
    listed = [name for name, table in TABLES.items() if table.domains]
    return quality.domain_violations(c.tables(*listed))


# --- second tier -------------------------------------------------------------------------------------

@query
def snapshot_file_changes(c):
    return diff.snapshot_file_changes(c.snapshot_base, c.snapshot_head)


@query
def class_dependencies(c):
    return search.class_dependencies(c.named, search.class_definitions(c.named))


@query
def dependency_counts(c):
    return search.dependency_counts(search.class_dependencies(c.named, search.class_definitions(c.named)))


@query
def semantic_topk(c):
    return search.semantic_topk(c.query_vectors, c.raw("embeddings"), TOP_K)


@query
def symbol_search(c):
    t = c.tables("classes", "methods")
    return search.symbol_search(t["classes"], t["methods"], PREFIX)


@query
def incremental_scan(c):
    """What changed between two commits of every tree, by parsing changed files only."""
    manifest, files = c.checkouts
    tables = {name: c.spark.createDataFrame([], table.schema) for name, table in TABLES.items()}
    index = c.spark.createDataFrame([], scan.INDEX_SCHEMA)
    for commit in (1, 2):
        tables, report, index = scan.scan_incrementally(
            tables, index, manifest.filter(F.col("commit") == commit).drop("commit"),
            files.filter(F.col("commit") == commit).drop("commit"))
    scans = report.select("scan_run_id", F.col("name").alias("tree"), "parsed_files")
    based = tables["scan_runs"].select(F.col("id").alias("scan_run_id"), "base_commit_sha", "head_commit_sha")
    return (tables["file_changes"].join(based, "scan_run_id").join(scans, "scan_run_id")
            .select("tree", "path", "old_path", "change_type", "additions", "deletions", "base_commit_sha",
                    "head_commit_sha", "parsed_files"))


@query
def scan_state_stream(c):
    """Every branch as the stream of finished scans left it."""
    base = shared_folder(c.spark, "scan-state")
    store = VersionedTables(c.spark, f"{base}/tables")
    scan_state.start_scan_state(c.scan_stream, store, f"{base}/checkpoint").awaitTermination()
    t = scan_state.read_state(store)
    branch = ["repository_id", "branch_id"]
    counts = [
        t["branch_commits"].groupBy(*branch).agg(F.count("*").alias("n_commits")),
        t["scan_runs"].groupBy(*branch).agg(F.count("*").alias("n_scans"), F.count_if(
            F.col("status") == "failed").alias("n_failed")),
        t["source_files"].groupBy(*branch).agg(F.count("*").alias("n_files"), F.sum("loc").alias("loc"),
                                               F.max("scan_run_id").alias("files_of")),
        t["repository_metrics"].groupBy(*branch).agg(F.count("*").alias("n_days"), F.sum("file_count").alias("day_files"))]
    rows = t["branches"].select(
        "repository_id", F.col("id").alias("branch_id"), F.col("name").alias("branch"), "is_default", F.col(
            "last_seen_commit_sha").alias("head_commit_sha"), F.col("created_at").alias("first_scan"),
        F.col("updated_at").alias("last_scan"))
    for part in counts:
        rows = rows.join(part, branch, "left")
    named = t["repositories"].select(F.col("id").alias("repository_id"), "url", "name")
    return _naive(rows.join(named, "repository_id").drop("repository_id", "branch_id")
                  .na.fill(0, ["n_files", "loc", "n_days", "day_files"]), "first_scan", "last_scan")


def _event_stream(c: Catalogue) -> DataFrame:
    schema = c.raw("events").schema
    # The last letter as a pattern: the table may be one file or a folder of parts.
    stream = c.spark.readStream.schema(schema).parquet(f"{c.folder}/events.parque[t]")
    return c.scan_events(stream)


@query
def incremental_scan_stream(c):
    base = shared_folder(c.spark, "latest-scans")
    scan_events.start_latest_scans(_event_stream(c), f"{base}/log", f"{base}/checkpoint"
                                   ).awaitTermination()
    return _naive(scan_events.read_latest_scans(c.spark, f"{base}/log"), "started_at")


@query
def daily_scan_counts_stream(c):
    base = shared_folder(c.spark, "daily-counts")
    scan_events.start_daily_counts(_event_stream(c), f"{base}/days", f"{base}/checkpoint"
                                   ).awaitTermination()
    return c.spark.read.schema("day date, trigger_type string, scans long").parquet(
        f"{base}/days").withColumn("day", F.col("day").cast("string"))
