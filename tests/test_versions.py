"""Versioned tables, the stream of scans into them, and incremental scans."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from srcstrata.operators import quality
from srcstrata.plans import scan
from srcstrata.schemas import TABLES
from srcstrata.session import configure, stored
from srcstrata.sources import source_tree
from srcstrata.sources.versions import Change, VersionedTables, VersionTaken
from srcstrata.streaming import scan_events, scan_state

FILES = "repository_id long, branch_id long, scan_run_id long, path string, language string, loc int"


def files(spark, *rows):
    return spark.createDataFrame(list(rows), FILES)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def parts(store):
    return {os.path.join(d, f) for d, _, names in os.walk(store.root) for f in names if f.endswith(".parquet")}


@pytest.fixture
def store(spark, tmp_path):
    return VersionedTables(spark, str(tmp_path / "tables"), buckets=8)


def test_versions_stay_readable_and_only_touched_buckets_are_written(spark, store):
    assert store.latest() == 0 and rows(store.read("source_files")) == []
    first = [(i, 1, 1, "a.py", "Python", i) for i in range(40)] + [(7, None, 1, "b.py", "Python", 1)]
    assert store.commit({"source_files": store.replace(files(spark, *first))}) == 1
    before = parts(store)
    new = [(7, None, 2, "c.py", "Python", 9)]
    scanned = spark.createDataFrame([(7, None), (8, 1)], "repository_id long, branch_id long")
    assert store.replace_branches({"source_files": files(spark, *new)}, scanned) == 2
    written = parts(store) - before
    assert len({p.split("bucket=")[1].split("/")[0] for p in written}) <= 2
    left = [r for r in first if r[:2] not in ((7, None), (8, 1))]
    assert rows(store.read("source_files")) == sorted(left + new, key=repr)
    assert rows(store.read("source_files", 1)) == sorted(first, key=repr)
    store.replace_branches({"source_files": files(spark, *new)}, scanned)
    assert store.expire(1) == 2 and store.versions() == [3]
    assert rows(store.read("source_files")) == sorted(left + new, key=repr)
    assert not parts(store) & written


def test_a_write_that_fails_before_its_rename_leaves_the_old_version(spark, store, monkeypatch):
    store.commit({"source_files": store.replace(files(spark, (1, 1, 1, "a.py", "Python", 1)))}, {"scans": 4})

    def fail(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", fail)
        with pytest.raises(RuntimeError, match="lost"):
            store.commit({"source_files": store.replace(files(spark))}, {"scans": 5})
    assert store.latest() == 1 and store.read("source_files").count() == 1
    assert store.manifest()["ledger"] == {"scans": 4}


def test_the_second_writer_of_a_version_fails(spark, store):
    base = store.manifest()
    store.commit({"source_files": store.replace(files(spark, (1, 1, 1, "a.py", "Python", 1)))}, base=base)
    with pytest.raises(VersionTaken):
        store.commit({"source_files": store.replace(files(spark))}, base=base)
    assert store.read("source_files").count() == 1


def test_rows_outside_of_their_buckets_are_refused(spark, store):
    with pytest.raises(ValueError, match="outside"):
        store.commit({"source_files": Change(files(spark, *[(i, 1, 1, "a", "Go", 1) for i in range(50)]), (0,))})
    assert store.latest() == 0


# the stream of scans

EVENTS = ("scan_run_id long, url string, name string, branch_name string, head_commit_sha string, author_name string, "
          "author_email string, message string, committed_at timestamp, trigger_type string, error_message string, "
          "event_time timestamp, files array<struct<path:string,language:string,loc:int>>")


def scans(n=60, seed=1):
    draw, out = random.Random(seed), []
    for i in range(n):
        when = dt.datetime(2026, 1, 1) + dt.timedelta(hours=draw.randrange(100))
        repository = draw.choice([0, 0, 0, 1, 2, 3])
        bad = draw.random() < 0.2
        out.append((i, f"https://h/{repository}", f"name {i}", draw.choice(["main", "dev"]), f"sha{draw.randrange(6)}",
                    f"author {i}", None, f"message {i}", when, "manual", "unreadable root" if bad else None, when,
                    None if bad else [(f"f{j}.py", "Python", i) for j in range(draw.randrange(3))]))
    return out


def by_name(tables):
    """The tables with ids replaced by what they name."""
    repository = {r.id: r.url for r in tables["repositories"].collect()}
    branch = {r.id: (repository[r.repository_id], r.name) for r in tables["branches"].collect()}
    commit = {r.id: (repository[r.repository_id], r.sha) for r in tables["commits"].collect()}
    out = {}
    for name, table in tables.items():
        held = []
        for r in table.collect():
            row = r.asDict()
            if name in ("repositories", "branches", "commits", "branch_commits"):
                row.pop("id")
            row.pop("is_default", None)
            for column, names in (("repository_id", repository), ("branch_id", branch), ("commit_id", commit)):
                if column in row:
                    row[column] = names[row[column]]
            held.append(tuple(row.values()))
        out[name] = sorted(held, key=repr)
    return out


def test_slices_late_scans_and_replays_equal_one_batch(spark, tmp_path):
    configure(spark)
    events = scans()
    whole = VersionedTables(spark, str(tmp_path / "whole"), buckets=4)
    scan_state.apply_scans(whole, spark.createDataFrame(events, EVENTS))
    expected = scan_state.read_state(whole)

    source, store = tmp_path / "in", VersionedTables(spark, str(tmp_path / "stream"), buckets=4)
    source.mkdir()
    stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(str(source))
    ordered = sorted(events, key=lambda e: e[11])
    late, rest = ordered[5:15], ordered[:5] + ordered[15:]
    slices = [rest[:20], rest[20:], late, events[:30]]  # the last one is a replay of events
    for i, part in enumerate(slices):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(str(source / f"s{i}"))
        scan_state.start_scan_state(stream, store, str(tmp_path / "checkpoint")).awaitTermination()
    found = scan_state.read_state(store)
    assert by_name(found) == by_name(expected)
    assert store.manifest()["ledger"] == {"scans": 3}
    for tables in (found, expected):
        full = {n: spark.createDataFrame([], t.schema) for n, t in TABLES.items()} | tables
        assert quality.unique_violations(full).count() == 0
        assert quality.foreign_key_violations(full).count() == 0
        defaults = tables["branches"].filter("is_default").groupBy("repository_id").count()
        assert defaults.count() == tables["repositories"].count() and defaults.filter("count > 1").count() == 0
    # Version 1 is still what the first slice left.
    assert scan_state.read_state(store, 1)["scan_runs"].count() == 20


def test_the_plain_definition_of_the_state(spark, tmp_path):
    events = scans(80, 2)
    store = VersionedTables(spark, str(tmp_path / "t"), buckets=4)
    scan_state.apply_scans(store, spark.createDataFrame(events, EVENTS))
    t = by_name(scan_state.read_state(store))
    ordered = sorted(events, key=lambda e: (e[11], e[0]))
    assert {(r[1], r[0]) for r in t["repositories"]} == {(e[1], e[2]) for e in {e[1]: e for e in ordered}.values()}
    last = {(e[1], e[3]): e for e in ordered if e[10] is None}
    assert sorted((r[1], r[2], r[3]) for r in t["source_files"]) == sorted(
        ((u, b), e[0], f[0]) for (u, b), e in last.items() for f in e[12])
    days = {((e[1], e[3]), e[11].date()): (e[0], len(e[12])) for e in ordered if e[10] is None}
    assert {(r[1], r[3]): (r[2], r[4]) for r in t["repository_metrics"]} == days
    assert len(t["scan_runs"]) == 80 and sum(r[5] == "failed" for r in t["scan_runs"]) == sum(e[10] is not None for e in events)


def test_a_batch_that_is_in_the_ledger_changes_nothing(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path / "t"), buckets=4)
    events = spark.createDataFrame(scans(10), EVENTS)
    assert scan_state.apply_scans(store, events, {"scans": 0}) == 1
    assert scan_state.apply_scans(store, events, {"scans": 0}) is None
    assert store.latest() == 1


def test_an_empty_stream_gives_empty_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    store = VersionedTables(spark, str(tmp_path / "t"))
    scan_state.start_scan_state(stream, store, str(tmp_path / "c")).awaitTermination()
    assert all(t.count() == 0 for t in scan_state.read_state(store).values())
    assert scan_events.read_latest_scans(spark, str(tmp_path / "no log")).count() == 0


# incremental scans

def write(root, said):
    for path, content in said.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content.encode() if isinstance(content, str) else content)


def checkout(root, scan_id, sha, day):
    return (str(root), None, f"https://h/{root.name}.git", None, "main", sha, "A", "a@e.org", "m",
            "2026-03-01T10:00:00Z", scan_id, "manual", dt.datetime(2026, 3, day))


MANIFEST = ("root string, url string, origin_url string, name string, branch_name string, head_commit_sha string, "
            "author_name string, author_email string, message string, committed_at string, scan_run_id long, "
            "trigger_type string, scanned_at timestamp")


def test_incremental_scans_equal_full_ones_and_parse_changed_files_only(spark, tmp_path):
    configure(spark)
    one, two = tmp_path / "one", tmp_path / "two"
    write(one, {"A.java": "class A {\n void f(int x) {\n", "B.java": "class B {\n", "c.py": "def g(x):\n pass\n",
                "gone.py": "x\ny\n", "same.go": "\n"})
    write(two, {"A.java": "class A {\n"})
    empty = {name: spark.createDataFrame([], table.schema) for name, table in TABLES.items()}
    full, part, index = empty, empty, spark.createDataFrame([], scan.INDEX_SCHEMA)

    def kept(tables):
        return {n: stored(t, n) if n in ("branch_commits", "scan_runs", "source_files", "classes", "methods",
                                         "repository_metrics", "file_changes") else t for n, t in tables.items()}

    def both(rows, compared=True):
        nonlocal full, part, index
        manifest = spark.createDataFrame(rows, MANIFEST)
        read = stored(source_tree.read_files(source_tree.list_entries(manifest.select("root"))), "read")
        part, report, index = scan.scan_incrementally(part, index, manifest, read)
        part, index = kept(part), stored(index, "index")
        if compared:
            full = kept(scan.scan_repositories(full, manifest, read)[0])
            for name in ("repositories", "branches", "commits", "branch_commits", "source_files", "classes", "methods",
                         "repository_metrics"):
                assert rows_of(part[name]) == rows_of(full[name]), name
        return {r.scan_run_id: r.parsed_files for r in report.collect()}

    def rows_of(frame):
        return sorted(map(tuple, frame.collect()), key=repr)

    assert both([checkout(one, 1, "a" * 40, 1), checkout(two, 2, "b" * 40, 1)]) == {1: 5, 2: 1}
    assert part["file_changes"].count() == 0
    write(one, {"A.java": "class A {\n void h(int x) {\n", "B2.java": "class B {\n", "new.py": "def n(x):\n"})
    for name in ("B.java", "gone.py"):
        (one / name).unlink()
    assert both([checkout(one, 3, "c" * 40, 2)]) == {3: 3}
    changes = sorted(tuple(r)[:6] for r in part["file_changes"].collect())
    assert changes == [(3, "A.java", None, "modified", 1, 1), (3, "B2.java", "B.java", "renamed", 0, 0),
                       (3, "gone.py", None, "deleted", 0, 2), (3, "new.py", None, "added", 1, 0)]
    runs = {r.id: r.base_commit_sha for r in part["scan_runs"].collect()}
    assert runs == {1: None, 2: None, 3: "a" * 40}
    assert quality.all_violations(part).count() == 0
    # A failed scan leaves index, files and changes; the next one compares with what is stored.
    write(one, {"bad.py": b"\xff", "c.py": "def k(x):\n"})
    both([checkout(one, 4, "d" * 40, 3)], False)
    assert part["file_changes"].count() == 4
    write(one, {"bad.py": "ok\n"})
    assert both([checkout(one, 5, "e" * 40, 4)], False) == {5: 2}
    assert sorted(tuple(r)[1:6] for r in part["file_changes"].filter("scan_run_id = 5").collect()) == [
        ("bad.py", None, "added", 1, 0), ("c.py", None, "modified", 1, 2)]


def test_a_full_bitmap_changes_nothing(spark, tmp_path, monkeypatch):
    """Every file taken for known by the bitmap is looked up, and parsed if it is not."""
    from srcstrata.operators import bitmap
    monkeypatch.setattr(bitmap, "WORD_BITS", 0)
    root = tmp_path / "r"
    write(root, {f"f{i}.py": f"def f{i}(x):\n" for i in range(200)})
    empty = {name: spark.createDataFrame([], table.schema) for name, table in TABLES.items()}
    index = spark.createDataFrame([], scan.INDEX_SCHEMA)
    for scan_id, day in ((1, 1), (2, 2)):
        manifest = spark.createDataFrame([checkout(root, scan_id, str(scan_id) * 40, day)], MANIFEST)
        read = source_tree.read_files(source_tree.list_trees(manifest.select("root")))
        empty, report, index = scan.scan_incrementally(empty, index, manifest, read)
        assert [r.parsed_files for r in report.collect()] == [200 if scan_id == 1 else 2]
        write(root, {"f7.py": "def other(x):\n", "g.py": "def g(x):\n"})
    assert empty["methods"].count() == 201


def test_an_unreadable_root_fails_its_scan_only(spark, tmp_path):
    configure(spark)
    write(tmp_path / "one", {"A.java": "class A {\n"})
    empty = {name: spark.createDataFrame([], table.schema) for name, table in TABLES.items()}
    manifest = spark.createDataFrame([checkout(tmp_path / "one", 1, "a" * 40, 1),
                                      checkout(tmp_path / "none", 2, "b" * 40, 1)], MANIFEST)
    entries = source_tree.list_entries(manifest.select("root"))
    tables, report = scan.scan_repositories(empty, manifest, source_tree.read_files(entries))
    assert {(r.name, r.status, r.error_message) for r in report.collect()} == {
        ("one", "completed", None), ("none", "failed", "unreadable root")}
    assert [r.path for r in tables["source_files"].collect()] == ["A.java"]


def test_rejected_manifest_rows(spark):
    from srcstrata.sources import listings
    given = spark.createDataFrame(
        [(1, " ", "abc", "  ", None, "m", "2026-01-01T00:00:00Z"), (2, "x", " ", "A", "e", None, None),
         (3, "x", "abc", "A", "e", None, "yesterday")],
        "id long, branch_name string, head_commit_sha string, author_name string, author_email string, message string, "
        "committed_at string")
    loaded = listings.load_commit_metadata(given)
    assert {r.id: r.problem for r in loaded.collect()} == {1: None, 2: "no commit id", 3: "time: yesterday"}
    assert tuple(loaded.filter("id = 1").select(*listings.COMMIT_COLUMNS[:5]).first()) == ("HEAD", "abc", None, None, "m")
    assert loaded.filter("id = 1").select(F.col("committed_at").cast("timestamp_ntz")).first()[0] == dt.datetime(2026, 1, 1)
    assert listings.rejected_commits(loaded).count() == 2


def test_tables_of_a_batch_are_written_once(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(scan_state, "stored", lambda df, purpose, *more: kept.append((purpose, df.columns)) or stored(df, purpose, *more))
    store = VersionedTables(spark, str(tmp_path / "t"), buckets=4)
    assert scan_state.apply_scans(store, spark.createDataFrame(scans(20), EVENTS)) == 1
    assert not [purpose for purpose, _ in kept if purpose.startswith("state-")]
    assert [purpose for purpose, columns in kept if "files" in columns] == ["events"]
    folders = {name: set(held["folders"].values()) for name, held in store.manifest()["tables"].items()}
    for name, named in folders.items():  # no other files than those of the version
        assert {f"data/{p.relative_to(tmp_path / 't/data').as_posix()}" for p in (tmp_path / "t/data" / name).glob("*/bucket=*")} == named


def test_no_rows_are_not_shuffled(spark, tmp_path, capsys):
    store = VersionedTables(spark, str(tmp_path / "t"))
    some = spark.range(10).withColumnRenamed("id", "repository_id").repartition("repository_id")
    some.join(store.read("branches", buckets=[1]), "repository_id", "left").explain()
    assert "Join" not in capsys.readouterr().out


def test_events_that_come_twice_in_a_batch_count_once(spark, tmp_path):
    once, twice = scans(30, 5), scans(30, 5)
    twice += twice[:12]
    held = []
    for name, given in (("once", once), ("twice", twice)):
        store = VersionedTables(spark, str(tmp_path / name), buckets=4)
        scan_state.apply_scans(store, spark.createDataFrame(given, EVENTS).repartition(5))
        held.append({n: sorted(map(repr, t.collect())) for n, t in scan_state.read_state(store).items()})
    assert held[0] == held[1] and len(held[0]["scan_runs"]) == 30
