"""The catalogue tables, manifests, trees and snapshots, derived from given tables.

Orders play scans, line items play file changes and metrics, customers and
suppliers play repositories, documents and web pages play source files. Every
adapter reads its tables whole; ``%`` only picks which variant a row becomes.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcstrata.functions.text import LINE_END
from srcstrata.operators import search, symbols
from srcstrata.operators.relational import top1_per_group
from srcstrata.schemas import ARTIFACT_FORMAT, ARTIFACT_TYPE, TABLES
from srcstrata.session import stored

# Events before this time made the stored state, those from it on are the batch.
CUT = "1998-06-01 00:00:00"
EXTENSIONS = ["java", "js", "py", "go"]
LANGUAGES = ["Java", "JavaScript", "Python", "Go"]

REPOSITORY = "o_custkey * 2"
CODE = "cast(substr(o_orderpriority, 1, 1) as int)"
BRANCH = f"o_custkey * 20 + {CODE}"


def _array(values) -> str:
    return f"array({', '.join(repr(v) for v in values)})"


class Catalogue:
    """Lazy DataFrames over one folder of given tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- catalogue tables ---------------------------------------------------

    @cached_property
    def repositories(self) -> DataFrame:
        epoch = "timestamp_ntz'1995-01-01 00:00:00' as created_at"
        customers = self.raw("customer").selectExpr(
            "c_custkey * 2 as id", "c_name as name",
            "concat('https://git.example/', lower(c_mktsegment), '/', c_name, '.git') as url", epoch,
            "timestamp_ntz'1995-01-01 00:00:00' as updated_at")
        suppliers = self.raw("supplier").selectExpr(
            "s_suppkey * 2 + 1 as id", "s_name as name",
            "concat('https://git.example/supply/', s_name, '.git') as url", epoch,
            "timestamp_ntz'1997-01-01 00:00:00' as updated_at")
        return customers.unionByName(suppliers)

    @cached_property
    def branches(self) -> DataFrame:
        grouped = self.raw("orders").groupBy("o_custkey", "o_orderpriority").agg(
            F.max("o_orderkey").alias("last_key"), F.min("o_orderdate").alias("created_at"),
            F.max("o_orderdate").alias("updated_at"))
        return grouped.selectExpr(
            f"{BRANCH} as id", f"{REPOSITORY} as repository_id", "o_orderpriority as name",
            f"({CODE} = min({CODE}) over (partition by o_custkey) or (o_custkey % 50 = 0 and "
            f"{CODE} = max({CODE}) over (partition by o_custkey))) as is_default",
            "md5(cast(last_key as string)) as last_seen_commit_sha",
            "md5(cast(last_key as string)) as last_scanned_commit_sha", "created_at", "updated_at")

    @cached_property
    def commits(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey as id", f"{REPOSITORY} as repository_id",
            "case when o_orderkey % 997 = 0 then ' ' else md5(cast(o_orderkey as string)) end as sha",
            "concat('Author ', o_orderstatus) as author_name",
            "concat(lower(o_orderstatus), '@example.org') as author_email",
            "concat('order ', o_orderkey, ' ', o_orderpriority) as message",
            "o_orderdate as committed_at", "o_orderdate as discovered_at")

    @cached_property
    def branch_commits(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey as id", f"{REPOSITORY} as repository_id", f"{BRANCH} as branch_id",
            "o_orderkey as commit_id", "o_orderdate as first_seen_at")

    @cached_property
    def scan_runs(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey as id", f"{REPOSITORY} as repository_id", f"{BRANCH} as branch_id",
            "cast(null as string) as base_commit_sha",
            "md5(cast(o_orderkey as string)) as head_commit_sha",
            "case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'pending' end "
            "as status",
            f"case {CODE} when 1 then 'webhook' when 2 then 'scheduled' when 5 then 'nightly' "
            "else 'manual' end as trigger_type",
            "o_orderdate as started_at",
            "case when o_orderstatus = 'F' then case when o_orderkey % 1000 = 7 "
            "then o_orderdate - interval '1' day else o_orderdate end end as completed_at",
            "cast(null as string) as error_message")

    @cached_property
    def file_changes(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey as scan_run_id",
            "case when l_linenumber = 1 and l_partkey % 9 = 0 then ' ' "
            "else concat('src/p', l_partkey % 50, '.java') end as path",
            "cast(null as string) as old_path",
            "case l_returnflag when 'A' then 'added' when 'R' then 'removed' else 'modified' end "
            "as change_type",
            "cast(l_quantity as int) - 2 as additions", "l_linenumber - 1 as deletions",
            "cast(null as string) as patch_uri")

    @cached_property
    def analysis_artifacts(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey as id", f"{REPOSITORY} as repository_id",
            f"case when {CODE} <> 5 then {BRANCH} end as branch_id",
            "case when o_orderstatus = 'F' then o_orderkey end as scan_run_id",
            f"{_array([*ARTIFACT_TYPE, 'unknown'])}[cast(o_orderkey % 6 as int)] as artifact_type",
            f"{_array([*ARTIFACT_FORMAT, 'xml'])}[cast(o_orderkey % 5 as int)] as format",
            "case when o_orderkey % 1009 = 0 then ' ' else concat('s3://artifacts/', o_custkey, '/', "
            "cast(cast(o_orderdate as date) as string)) end as uri",
            "md5(o_orderpriority) as content_hash", "o_orderdate as generated_at")

    @cached_property
    def repository_metrics(self) -> DataFrame:
        lines = self.raw("lineitem").join(
            self.raw("orders"), F.expr("l_orderkey = o_orderkey")).selectExpr(
            f"{REPOSITORY} as repository_id", f"{BRANCH} as branch_id", "o_orderkey as scan_run_id",
            "l_shipdate", "l_partkey", "l_linenumber")
        return daily_metrics(lines).unionByName(daily_metrics(self.supplier_lines))

    @cached_property
    def supplier_lines(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_suppkey * 2 + 1 as repository_id", "cast(null as bigint) as branch_id",
            "cast(null as bigint) as scan_run_id", "l_shipdate", "l_partkey", "l_linenumber",
            "l_linestatus")

    @cached_property
    def risk_scores(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey as id", f"{REPOSITORY} as repository_id",
            f"case when {CODE} <> 4 then {BRANCH} end as branch_id", "o_orderkey as scan_run_id",
            "concat('module', o_orderkey % 100) as module_name",
            "cast(cast(floor(o_totalprice / 4000) as int) as decimal(5,2)) as score",
            "cast(null as string) as reason", "o_orderdate as generated_at")

    @cached_property
    def technical_debt(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey as id", f"{REPOSITORY} as repository_id",
            f"case when {CODE} <> 3 then {BRANCH} end as branch_id", "o_orderkey as scan_run_id",
            "concat('module', o_orderkey % 100) as module_name", "o_orderstatus as type",
            "o_orderpriority as severity",
            "case when o_orderkey % 500 <> 3 then concat('debt of order ', o_orderkey) end "
            "as description", "o_orderdate as created_at")

    # --- source files ---------------------------------------------------------

    @cached_property
    def file_contents(self) -> DataFrame:
        """Documents written as code line by line, and pages as they are."""
        documents = self.raw("documents").select("doc_id", "text", "source").select(
            F.expr("doc_id div 50 * 2").alias("repository_id"),
            F.expr("doc_id div 50 * 20 + 1 + doc_id % 50 div 25").alias("branch_id"),
            F.col("doc_id").alias("scan_run_id"),
            F.expr(f"concat('src/', source, '/', doc_id, '.', {_array(EXTENSIONS)}"
                   "[cast(doc_id % 4 as int)])").alias("path"),
            F.expr(f"{_array(LANGUAGES)}[cast(doc_id % 4 as int)]").alias("language"),
            _code_of(F.col("text"), F.col("doc_id")).alias("content"))
        pages = self.raw("pages").select("page_id", "html").selectExpr(
            "page_id div 50 * 2 as repository_id", "page_id div 50 * 20 + 3 as branch_id",
            "page_id as scan_run_id", "concat('web/', page_id, '.js') as path",
            "'JavaScript' as language", "html as content")
        return documents.unionByName(pages)

    @cached_property
    def lines(self) -> DataFrame:
        return symbols.with_lines(self.file_contents)

    @cached_property
    def matched(self) -> DataFrame:
        return symbols.match_symbols(self.lines)

    @cached_property
    def symbols(self) -> DataFrame:
        return symbols.file_symbols(self.matched)

    @cached_property
    def source_files(self) -> DataFrame:
        return symbols.file_rows(self.matched, F.col("scan_run_id"))

    @cached_property
    def classes(self) -> DataFrame:
        return symbols.class_rows(self.symbols)

    @cached_property
    def methods(self) -> DataFrame:
        return symbols.method_rows(self.symbols)

    @cached_property
    def named(self) -> DataFrame:
        return stored(search.file_names(self.lines), "named")

    @cached_property
    def dependencies(self) -> DataFrame:
        return search.dependency_rows(search.class_dependencies(self.named, search.class_definitions(self.named)))

    def tables(self, *names: str) -> dict[str, DataFrame]:
        """The named tables, or all fourteen, with their declared columns.

        What the scan found is read more than once by the checks and deletes,
        so it is stored first and not extracted again. Where the dependencies are
        among them, one pass over the texts finds symbols and tokens alike.
        """
        names = names or tuple(TABLES)
        if {"source_files", "classes", "methods"} & set(names):
            if "dependencies" in names:
                found = stored(search.match_names(self.lines), "matched")
                self.matched, self.named = found.drop("tokens"), search.matched_names(found)
            else:
                self.matched = stored(self.matched, "matched")
        if {"classes", "methods"} & set(names):
            self.symbols = stored(self.symbols, "symbols")
        if "dependencies" in names:
            self.dependencies = stored(self.dependencies, "dependencies")
        return {name: getattr(self, name).select(*TABLES[name].names) for name in names}

    # --- manifests and listings -------------------------------------------------

    @cached_property
    def manifest(self) -> DataFrame:
        return self.raw("pages").selectExpr(
            "page_id",
            "case page_id % 8 when 0 then url "
            "when 1 then concat('git@host.example:org/p', page_id, '.git') "
            "when 2 then concat('HTTPS://host.example/org/p', page_id) when 3 then '  ' "
            "when 4 then concat('https://host.example/org/p', page_id, '/') "
            "when 5 then concat('ftp://host.example/p', page_id) "
            "when 6 then concat(' https://host.example/org/p ', page_id, '.git ') "
            "else 'https:///nohost' end as repo_url",
            "case page_id % 3 when 0 then concat('  repo ', page_id, chr(9)) when 1 then '' end "
            "as repo_name",
            "case when page_id % 5 = 0 then '' else url end as origin_url",
            "concat('/data/my repos/p~', page_id, '+é') as root_path",
            "case when page_id % 4 <> 1 then 'main' end as branch_name",
            "md5(url) as head_commit_sha",
            "case page_id % 2 when 0 then '2026-01-02T03:04:05+02:00' "
            "else '2026-01-02T03:04:05Z' end as committed_at",
            "case when page_id % 6 <> 2 then concat(' Author ', page_id % 9, ' ') end as author_name",
            "case page_id % 4 when 0 then ' ' else concat('a', page_id % 9, '@example.org') end as author_email",
            "concat('change of ', url, chr(10), ' ') as message")

    @cached_property
    def paths(self) -> DataFrame:
        return self.raw("documents").selectExpr(
            "doc_id",
            "concat(case doc_id % 7 when 0 then 'node_modules/' when 1 then 'src/build/' "
            "when 2 then '.github/' when 3 then 'Build/' when 4 then 'src/builder/' else 'src/' end, "
            "source, '/d', doc_id, '/', case doc_id % 11 when 0 then 'Main.java' "
            "when 1 then '__init__.py' when 2 then '.eslintrc.js' when 3 then 'py' "
            "when 4 then 'a.test.ts' when 5 then 'README.md' when 6 then 'X.KT' when 7 then 'x.hpp' "
            "when 8 then '.py' when 9 then 'noext' else 'out' end) as path")

    @cached_property
    def branch_lines(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey",
            "case c_custkey % 5 when 0 then concat('  ', md5(c_name), '  refs/heads/', lower(c_name)) "
            "when 1 then concat(md5(c_name), chr(9), 'refs/heads/feature/', lower(c_name)) "
            "when 2 then ' ' when 3 then concat(md5(c_name), chr(9), 'refs/tags/v1') "
            "else concat(md5(c_name), chr(9), 'refs/heads/', lower(c_name)) end as line")

    # --- snapshots, deletes, vectors, events -------------------------------------

    @cached_property
    def snapshot_base(self) -> DataFrame:
        return self.raw("documents").selectExpr(
            "concat('src/', source, '/', doc_id, '.txt') as path", "text as content")

    @cached_property
    def snapshot_head(self) -> DataFrame:
        """Documents that are not toxic, some moved, some grown; copies of good ones; pages."""
        documents, labels = self.raw("documents"), self.raw("labels")
        kept = documents.join(labels.filter("toxic = 1"), "doc_id", "left_anti").selectExpr(
            "case when doc_id % 11 = 0 then concat('moved/', doc_id, '.txt') "
            "else concat('src/', source, '/', doc_id, '.txt') end as path",
            "case when doc_id % 5 = 0 then concat(text, chr(10), 'extra') else text end as content")
        copies = documents.join(labels.filter("quality = 1"), "doc_id", "left_semi").selectExpr(
            "concat('copy/', doc_id, '.txt') as path", "text as content")
        pages = self.raw("pages").selectExpr("concat('web/', page_id, '.html') as path",
                                             "html as content")
        return kept.unionByName(copies).unionByName(pages)

    @cached_property
    def delete_ids(self) -> DataFrame:
        """Repositories in debt, and one id that does not exist."""
        unknown = self.raw("customer").selectExpr("min(c_custkey) - 1 as id")
        return self.raw("customer").filter("c_acctbal < 0").selectExpr(
            "c_custkey * 2 as id").unionByName(unknown)

    @cached_property
    def query_vectors(self) -> DataFrame:
        """The requests: every vector whose id is divisible by 20."""
        return self.raw("embeddings").filter("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding")

    @cached_property
    def checkouts(self) -> tuple[DataFrame, DataFrame]:
        """(manifest, files) of trees of fifty documents each, at two commits.

        The second commit lacks toxic documents, some files moved and some grew.
        """
        documents = self.raw("documents").selectExpr(
            "doc_id", "concat('/trees/', doc_id div 50) as root", "coalesce(text, '') as text",
            "concat(source, '/', doc_id, '.', " + _array(EXTENSIONS) + "[cast(doc_id % 4 as int)]) as name")
        toxic = self.raw("labels").filter("toxic = 1")
        first = documents.selectExpr("root", "1 as commit", "concat('src/', name) as path", "text")
        second = documents.join(toxic, "doc_id", "left_anti").selectExpr(
            "root", "2 as commit", "concat(case when doc_id % 11 = 0 then 'moved/' else 'src/' end, name) as path",
            "case when doc_id % 5 = 0 then concat(text, chr(10), 'extra') else text end as text")
        files = first.unionByName(second).selectExpr(
            "commit", "root", "path", "cast(octet_length(text) as long) as size", "cast(text as binary) as content")
        roots = documents.select("root").distinct().withColumn("commit", F.explode(F.array(F.lit(1), F.lit(2))))
        manifest = roots.selectExpr(
            "commit", "root", "concat('https://git.example', root, '.git') as url",
            "cast(null as string) as origin_url", "cast(null as string) as name", "'main' as branch_name",
            "md5(concat(root, commit)) as head_commit_sha", "'An Author' as author_name",
            "'a@example.org' as author_email", "concat('commit ', commit) as message",
            "'2026-01-02T03:04:05Z' as committed_at", "cast(substr(root, 8) as long) * 2 + commit as scan_run_id",
            "'manual' as trigger_type", "timestamp'2026-01-03 00:00:00' + make_interval(0, 0, 0, commit) "
            "as scanned_at")
        return manifest, files

    @cached_property
    def scan_stream(self) -> DataFrame:
        """Orders as a stream of finished scans with their files."""
        # The last letter as a pattern: the table may be one file or a folder of parts.
        raw = self.spark.readStream.schema(self.raw("orders").schema).parquet(f"{self.folder}/orders.parque[t]")
        return raw.selectExpr(
            "o_orderkey as scan_run_id", "concat('https://git.example/r', o_custkey, '.git') as url",
            "concat('r', o_custkey, ' ', o_orderstatus) as name", "o_orderpriority as branch_name",
            "md5(concat(o_custkey, '/', year(o_orderdate))) as head_commit_sha",
            "concat('Author ', o_orderkey % 7) as author_name", "'a@example.org' as author_email",
            "concat('order ', o_orderkey) as message", "o_orderdate as committed_at", "'scheduled' as trigger_type",
            "case when o_orderkey % 13 = 0 then 'unreadable root' end as error_message", "o_orderdate as event_time",
            "case when o_orderkey % 13 <> 0 then transform(sequence(0, cast(o_orderkey % 4 as int)), i -> named_struct("
            "'path', concat('src/f', i, '.java'), 'language', 'Java', 'loc', cast(i + o_orderkey % 10 as int))) end "
            "as files")

    def scan_events(self, raw: DataFrame) -> DataFrame:
        """Scan events; the event time is cast because watermarks need ``timestamp``."""
        return raw.selectExpr(
            "event_id as scan_run_id", "user_id as repository_id",
            "md5(cast(event_id as string)) as head_commit_sha",
            "case event_type when 'error' then 'failed' else 'completed' end as status",
            "case event_type when 'click' then 'webhook' when 'view' then 'scheduled' "
            "else 'manual' end as trigger_type", "cast(ts as timestamp) as started_at")

    # --- state and batch of the state changes ---------------------------------------

    @cached_property
    def shipments(self) -> DataFrame:
        """Line items as events of their order's repository, branch and commit."""
        return self.raw("lineitem").join(
            self.raw("orders"), F.expr("l_orderkey = o_orderkey")).selectExpr(
            f"{REPOSITORY} as repository_id", f"{BRANCH} as branch_id", "o_orderkey as commit_id",
            "md5(cast(o_orderkey as string)) as sha", "o_orderpriority as name",
            "concat('Part ', l_partkey) as author_name", "l_shipdate as event_time",
            # A line number may repeat inside an order, so the part and the price break ties.
            "l_linenumber * 100000000 + l_partkey * 100 + cast(l_quantity as int) as event_id")

    def split(self, events: DataFrame, time: str = "event_time") -> tuple[DataFrame, DataFrame]:
        cut = F.lit(CUT).cast("timestamp_ntz")
        return events.filter(F.col(time) < cut), events.filter(F.col(time) >= cut)

    def empty(self, name: str) -> DataFrame:
        """An empty table with NTZ times, as the given tables have them."""
        fields = [T.StructField(f.name, T.TimestampNTZType() if isinstance(f.dataType, T.TimestampType)
                                else f.dataType) for f in TABLES[name].schema]
        return self.spark.createDataFrame([], T.StructType(fields))

    @cached_property
    def newest_scans(self) -> DataFrame:
        return top1_per_group(self.scan_runs, ["repository_id", "branch_id"],
                              [F.col("started_at").desc(), F.col("id").desc()])


def daily_metrics(lines: DataFrame) -> DataFrame:
    return lines.groupBy("repository_id", "branch_id", F.to_date("l_shipdate").alias("date")).agg(
        F.max("scan_run_id").alias("scan_run_id"),
        F.countDistinct("l_partkey").cast("int").alias("file_count"),
        F.count("*").cast("int").alias("class_count"),
        F.sum("l_linenumber").cast("int").alias("method_count"),
        F.lit(0).alias("dependency_count"))


def _code_of(text, doc_id):
    """One code line per text line, the whole text kept in comments; every line end occurs."""
    end = F.when(doc_id % 3 == 0, "\n").when(doc_id % 3 == 1, "\r\n").otherwise("\r")

    def line(x, i):
        word = F.regexp_extract(x, "[A-Za-z]+", 0)
        word = F.when(word == "", "x").otherwise(word)
        note = F.concat(F.lit(" // "), F.regexp_replace(x, r"[^\w ]", " "))
        k = (doc_id + i) % 8
        return (F.when(k == 0, F.concat(F.lit("class "), word, F.lit(" {"), note))
                .when(k == 1, F.concat(F.lit("public void "), word, F.lit("(int a) {"), note))
                .when(k == 2, F.concat(F.lit("if ("), word, F.lit("(x)) {"), note))
                .when(k == 3, F.concat(F.lit("function "), word, F.lit("(a) {"), note))
                .when(k == 4, F.concat(F.lit("const "), word, F.lit(" = (a) => a;"), note))
                .when(k == 5, F.concat(F.lit("def "), word, F.lit("(self):"), note))
                .when(k == 6, F.concat(F.lit("//"), note, end, F.lit(" \t")))
                .otherwise(F.concat(F.lit("// "), x)))

    code = F.transform(F.split(text, LINE_END, -1), line)
    return F.concat(F.call_function("array_join", code, end),
                    F.when(doc_id % 5 == 0, end).otherwise(""))
