"""Trees on disk, branch listings and the snapshot sink."""

import pytest
from pyspark.sql import functions as F

from srcstrata.sources import listings, source_tree, tables


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "build" / "repo"  # a skipped name above the root does not count
    for path, content in {
        "a.py": b"x", "pkg/__init__.py": b"", "pkg/.eslintrc.js": b"y", ".github/w.js": b"z",
        "build/gen.py": b"no", "src/out/gen.py": b"no", "src/Build/a.py": b"yes", "src/out.py": b"o",
        "src/target": b"no", "deep/a/b/c/d/e.py": b"e", "exact.py": b"a" * 1_000_000,
        "over.py": b"a" * 1_000_001, "bad.py": b"\xff",
    }.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    (root / "linked.py").symlink_to(root / "a.py")
    (root / "linked_dir").symlink_to(root / "pkg")
    (root / "broken.py").symlink_to(root / "missing.py")
    return root


EXPECTED = {"a.py", "pkg/__init__.py", "pkg/.eslintrc.js", ".github/w.js", "src/Build/a.py", "src/out.py",
            "deep/a/b/c/d/e.py", "exact.py", "bad.py", "linked.py"}


def test_data_source(spark, tree):
    rows = source_tree.read_tree(spark, str(tree)).collect()
    assert {r.path for r in rows} == EXPECTED
    assert {r.path: bytes(r.content) for r in rows}["bad.py"] == b"\xff"
    assert all(r["size"] == len(r.content) for r in rows)


@pytest.mark.parametrize("parts", [1, 2, 40])
def test_data_source_partitioning_changes_nothing(spark, tree, parts):
    df = source_tree.read_tree(spark, str(tree), partitions=parts)
    assert sorted(r.path for r in df.select("path").collect()) == sorted(EXPECTED)


def test_file_uri_and_cap_option(spark, tree):
    df = source_tree.read_tree(spark, f"file://{tree}", max_file_bytes=1)
    assert "exact.py" not in {r.path for r in df.collect()}


def test_format_reads_the_same_files(spark, tree):
    spark.dataSource.register(source_tree.SourceTree)
    df = spark.read.format("source_tree").option("path", str(tree)).load()
    assert {r.path for r in df.collect()} == EXPECTED


def test_every_entry_has_a_row_and_a_reason(spark, tree):
    roots = spark.createDataFrame([(str(tree),), (str(tree / "nowhere"),)], "root string")
    entries = source_tree.list_entries(roots).collect()
    reasons = {r.path: r.reason for r in entries if r.root == str(tree) and r.reason}
    assert reasons == {"build": "skipped folder", "src/out": "skipped folder", "src/target": "skipped folder",
                       "over.py": "size", "broken.py": "unreadable size"}
    assert [(r.path, r.reason) for r in entries if r.root != str(tree)] == [("", "unreadable root")]
    assert {r.path: r["size"] for r in entries}["over.py"] == 1_000_001
    with pytest.raises(Exception, match="unreadable root"):
        source_tree.read_tree(spark, str(tree / "nowhere")).collect()


@pytest.mark.parametrize("folders", [1, 2, 1000])
def test_many_trees(spark, tree, folders):
    roots = spark.createDataFrame([(1, str(tree)), (2, str(tree / "pkg"))], "id long, root string")
    files = source_tree.list_trees(roots, folders_per_task=folders, partitions=2)
    got = source_tree.read_files(files).collect()
    assert {r.path for r in got if r.id == 1} == EXPECTED
    assert {r.path for r in got if r.id == 2} == {"__init__.py", ".eslintrc.js"}
    assert len(got) == len(EXPECTED) + 2
    assert all(len(r.content) == r["size"] for r in got)


def test_export_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a/_b.py", "é"), (".c.js", "")], "path string, content string")
    source_tree.export_tree(df, str(tmp_path / "out"))
    back = source_tree.read_tree(spark, str(tmp_path / "out")).collect()
    assert {r.path: bytes(r.content).decode() for r in back} == {"a/_b.py": "é", ".c.js": ""}


def branch_lines(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "line string")


def test_branch_listing(spark):
    parsed = listings.parse_branch_listing(branch_lines(
        spark, " abc \trefs/heads/feature/x ", "", "  ", "abc refs/tags/v1", "abc", "d\trefs/heads/"))
    assert {(r.line, r.name, r.commit_sha, r.is_valid) for r in parsed.collect()} == {
        (" abc \trefs/heads/feature/x ", "feature/x", "abc", True),
        ("abc refs/tags/v1", None, None, False), ("abc", None, None, False),
        ("d\trefs/heads/", "", "d", True)}
    assert listings.rejected_lines(parsed).count() == 2


def test_branch_listing_strict(spark):
    good = listings.parse_branch_listing(branch_lines(spark, "abc refs/heads/x"), strict=True)
    assert good.first().name == "x"
    with pytest.raises(Exception, match="unexpected branch line: abc refs/tags/v1"):
        listings.parse_branch_listing(branch_lines(spark, "abc refs/tags/v1"), strict=True).collect()


FILES = "repository_id long, branch_id long, scan_run_id long, path string, language string, loc int, file_key string"


def test_snapshot_sink(spark, tmp_path):
    folder = str(tmp_path / "source_files")

    def rows(*data):
        return spark.createDataFrame(list(data), FILES)

    def scanned(*pairs):
        return spark.createDataFrame(list(pairs), "repository_id long, branch_id long")

    def stored():
        return [tuple(r) for r in tables.read_snapshot(spark, folder, "source_files").collect()]

    first = [(1, 1, 10, "a.py", "Python", 1, "a"), (1, 2, 10, "b.py", "Python", 2, "b"),
             (2, None, 10, "c.py", "Python", 3, "c")]
    tables.write_snapshot(rows(*first), scanned((1, 1), (1, 2), (2, None)), folder)
    assert set(stored()) == set(first)
    # Branch 1 is replaced, branch 2 was scanned empty, repository 2 not at all.
    second = [(1, 1, 11, "z.py", "Python", 9, "z")]
    tables.write_snapshot(rows(*second), scanned((1, 1), (1, 2)), folder)
    assert set(stored()) == {*second, first[2]}
    # The same scan written twice leaves the same rows, and the cleared branch can fill again.
    tables.write_snapshot(rows(*second), scanned((1, 1), (1, 2)), folder)
    assert set(stored()) == {*second, first[2]}
    tables.write_snapshot(rows((1, 2, 12, "n.py", "Python", 4, "n")), scanned((1, 2)), folder)
    assert set(stored()) == {*second, first[2], (1, 2, 12, "n.py", "Python", 4, "n")}


def test_partition_filter_prunes(spark, tmp_path):
    folder = str(tmp_path / "f")
    df = spark.createDataFrame([(i, 1, 1, "a.py", "Python", 1, str(i)) for i in range(5)], FILES)
    tables.write_snapshot(df, df, folder)
    read = tables.read_snapshot(spark, folder, "source_files").filter(F.col("repository_id") == 3)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(repository_id" in plan
    assert [r.repository_id for r in read.collect()] == [3]
