"""A scan from trees on disk to catalogue tables."""

import datetime as dt

from pyspark.sql import functions as F

from srcstrata.operators import cascade, quality, summary
from srcstrata.plans import scan
from srcstrata.plans.adapters import Catalogue
from srcstrata.schemas import TABLES
from srcstrata.session import configure
from srcstrata.sources import source_tree


def write(root, files):
    for path, content in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(content)


def run(spark, tables, checkouts):
    manifest = spark.createDataFrame(
        checkouts, "root string, url string, origin_url string, name string, branch_name string, "
        "head_commit_sha string, author_name string, author_email string, message string, "
        "committed_at string, scan_run_id long, trigger_type string, scanned_at timestamp")
    files = source_tree.read_files(source_tree.list_trees(manifest.select("root")))
    return scan.scan_repositories(tables, manifest, files)


def test_two_scans_of_three_repositories(spark, tmp_path):
    configure(spark)
    write(tmp_path / "one", {"A.java": "class A {\n  void f(int x) {\n", "build/B.java": "class B {",
                             "README.md": "class C", "pkg/__init__.py": "def g(x):\n"})
    write(tmp_path / "two", {"x.go": "\n"})
    (tmp_path / "three").mkdir()
    empty = {name: spark.createDataFrame([], table.schema) for name, table in TABLES.items()}
    day = dt.datetime(2026, 3, 1, 12)

    def checkout(folder, scan_id, branch="main", when=day, sha="a" * 40):
        return (str(tmp_path / folder), None, f"https://h/{folder}.git", " " if folder == "two" else None,
                branch, sha, "An Author", "a@example.org", "message", "2026-03-01T10:00:00+02:00",
                scan_id, "manual", when)

    tables, report = run(spark, empty, [checkout("one", 1), checkout("two", 2), checkout("three", 3)])
    assert {(r.name, r.branch, r.scan_run_id, r.file_count, r.class_count, r.method_count)
            for r in report.collect()} == {("one", "main", 1, 2, 2, 2), ("two", "main", 2, 1, 0, 0),
                                           ("three", "main", 3, 0, 0, 0)}
    assert quality.all_violations({n: tables[n] for n in tables}).count() == 0
    committed = tables["commits"].select(F.col("committed_at").cast("timestamp_ntz")).first()[0]
    assert committed == dt.datetime(2026, 3, 1, 8)

    # One file goes, a branch is added; the other repositories are not scanned.
    (tmp_path / "one" / "A.java").unlink()
    later = day + dt.timedelta(days=1)
    tables, report = run(spark, tables, [checkout("one", 4, when=later, sha="b" * 40),
                                         checkout("two", 5, "dev", later)])
    assert {(r.name, r.branch, r.file_count) for r in report.collect()} == {
        ("one", "main", 1), ("two", "dev", 1)}
    assert quality.all_violations(tables).count() == 0
    listed = {r.name: (r.branch_count, r.latest_branch, r.latest_scan_run_id, r.latest_scan_status,
                       r.file_count, r.class_count, r.method_count)
              for r in summary.list_repositories(
                  tables["repositories"], tables["branches"], tables["scan_runs"],
                  tables["repository_metrics"]).collect()}
    assert listed == {"one": (1, "main", 4, "completed", 1, 1, 1),
                      "two": (2, "dev", 5, "completed", 1, 0, 0),
                      "three": (1, "main", 3, "completed", 0, 0, 0)}
    assert {(r.path, r.language) for r in tables["source_files"].collect()} == {
        ("pkg/__init__.py", "Python"), ("x.go", "Go")}
    assert tables["source_files"].count() == 3
    defaults = {(r.name, r.is_default) for r in tables["branches"].filter("name = 'dev'").collect()}
    assert defaults == {("dev", False)}


def test_bad_rows_and_files_touch_their_own_scan_only(spark, tmp_path):
    configure(spark)
    write(tmp_path / "one", {"A.java": "class A {\n"})
    write(tmp_path / "next", {"A.java": "class B {\n void f() {", "C.java": "class C"})
    write(tmp_path / "bad", {"A.java": "class A {\n"})
    (tmp_path / "bad" / "B.java").write_bytes(b"class \xff")
    empty = {name: spark.createDataFrame([], table.schema) for name, table in TABLES.items()}
    day = dt.datetime(2026, 3, 1, 12)

    def row(folder, scan_id, url="https://h/o/one.git", branch="main", sha="a" * 40, days=0):
        return (str(tmp_path / folder), url, None, None, branch, sha, None, None, None, None, scan_id, "manual",
                day + dt.timedelta(days=days))

    rows = [row("one", 1), row("next", 2, days=1), row("bad", 3, days=2), row("one", 4, "https://h/o/two", None),
            row("one", 5, "https://h/o/three", sha=None), row("one", 6, "not a url ::"),
            row("bad", 7, "https://h/o/bad")]
    tables, report = run(spark, empty, rows)
    got = {r.scan_run_id: (r.status, r.name, r.branch, r.file_count, r.class_count) for r in report.collect()}
    assert got == {1: ("completed", "one", "main", 1, 1), 2: ("completed", "one", "main", 2, 2),
                   3: ("failed", "one", "main", None, None), 4: ("completed", "two", "HEAD", 1, 1),
                   5: ("rejected", "three", "main", None, None), 6: ("rejected", got[6][1], "main", None, None),
                   7: ("failed", "bad", "main", None, None)}
    assert len(rows) == report.count()
    assert "B.java" in report.filter("scan_run_id = 3").first().error_message
    assert {(r.id, r.status) for r in tables["scan_runs"].collect()} == {
        (1, "completed"), (2, "completed"), (3, "failed"), (4, "completed"), (7, "failed")}
    assert sorted((r.scan_run_id, r.path) for r in tables["source_files"].collect()) == [
        (2, "A.java"), (2, "C.java"), (4, "A.java")]
    assert sorted(r.name for r in tables["classes"].collect()) == ["A", "B", "C"]
    assert sorted((r.scan_run_id, r.file_count) for r in tables["repository_metrics"].collect()) == [
        (1, 1), (2, 2), (4, 1)]


def test_children_of_files_without_branch(spark):
    configure(spark)
    tables = {name: spark.createDataFrame([], table.schema) for name, table in TABLES.items()}

    def add(name, *rows):
        names = TABLES[name].names
        tables[name] = spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], TABLES[name].schema)

    when = dt.datetime(2026, 1, 1)
    add("repositories", *({"id": i, "name": "r", "url": str(i), "created_at": when, "updated_at": when} for i in (1, 2)))
    files = [{"repository_id": r, "branch_id": None, "path": "A", "loc": 1, "file_key": f"key {r}"} for r in (1, 2)]
    add("source_files", *files)
    add("classes", *({**f, "name": "A", "method_count": 1} for f in files),
        {**files[0], "path": "gone", "file_key": "gone", "name": "X", "method_count": 0})
    add("methods", *({**f, "class_name": "A", "name": "m", "complexity": 0} for f in files))
    assert [(r.table_name, r.key, r.detail) for r in quality.foreign_key_violations(tables).collect()] == [
        ("classes", "gone", "1")]
    after, _ = cascade.delete_repositories(tables, spark.createDataFrame([(1,)], "id long"))
    for name in ("source_files", "methods"):
        assert [r.repository_id for r in after[name].collect()] == [2]
    assert sorted((r.repository_id, r.path) for r in after["classes"].collect()) == [(1, "gone"), (2, "A")]


def test_two_deleted_branches_keep_their_files_apart(spark, tmp_path):
    configure(spark)
    tables = {name: spark.createDataFrame([], table.schema) for name, table in TABLES.items()}
    day = dt.datetime(2026, 3, 1, 12)
    for i, branch in enumerate(("a", "b", "c")):
        write(tmp_path / branch, {"A.java": f"class A{branch} {{\n  void f(int x) {{\n"})
        tables, _ = run(spark, tables, [(str(tmp_path / branch), "https://h/o/r", None, None, branch, str(i) * 40, None,
                                         None, None, None, i + 1, "manual", day + dt.timedelta(days=i))])
    dead = tables["branches"].filter("name <> 'c'").select("id")
    after, unknown = cascade.delete_branches(tables, dead)
    assert unknown.count() == 0
    # The natural keys of two files are alike now, which is reported; their classes and methods are not mixed up.
    assert {r.rule for r in quality.unique_violations(after).collect()} == {"unique_repository_id_branch_id_path"}
    assert quality.foreign_key_violations(after).count() == 0
    owner = {r.file_key: r.branch_id for r in after["source_files"].collect()}
    assert len(owner) == 3 and sum(b is None for b in owner.values()) == 2
    assert len({(r.file_key, r.name) for r in after["classes"].collect()}) == 3
    assert all(owner[r.file_key] == r.branch_id for name in ("classes", "methods") for r in after[name].collect())
    gone, _ = cascade.delete_repositories(after, after["repositories"].select("id"))
    assert all(gone[name].count() == 0 for name in TABLES)


def test_dropped_files_have_a_reason(spark):
    files = spark.createDataFrame([("r", "A.java", 1), ("r", "build/A.java", 1), ("r", "x.md", 1),
                                   ("r", "B.java", 2_000_000), ("r", "C.java", None)],
                                  "root string, path string, size long")
    assert sorted((r.path, r.reason) for r in scan.dropped_files(files).collect()) == [
        ("B.java", "size"), ("C.java", "size"), ("build/A.java", "skipped folder"), ("x.md", "unknown language")]
    assert scan.source_candidates(files).count() + scan.dropped_files(files).count() == files.count()


def test_catalogue_covers_every_table(spark):
    c = Catalogue(configure(spark), "/root/testdata/sf0.001")
    assert set(c.tables("repositories", "branches")) == {"repositories", "branches"}
