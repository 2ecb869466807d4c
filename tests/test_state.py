"""State changes: idempotence, nulls, defaults, deletes, checks."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from srcstrata.operators import cascade, quality, state, summary
from srcstrata.operators.relational import rank_in_group
from srcstrata.plans.adapters import Catalogue

T0 = dt.datetime(2026, 1, 1)


def at(day):
    return T0 + dt.timedelta(days=day)


REPOSITORIES = "id long, name string, url string, created_at timestamp_ntz, updated_at timestamp_ntz"
BRANCHES = ("id long, repository_id long, name string, is_default boolean, last_seen_commit_sha string, "
            "last_scanned_commit_sha string, created_at timestamp_ntz, updated_at timestamp_ntz")


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_upsert_repositories(spark):
    known = spark.createDataFrame([(7, "old", "u1", at(0), at(0)), (9, "keep", "u2", at(0), at(0))],
                                  REPOSITORIES)
    batch = spark.createDataFrame(
        [("u1", "mid", at(1), 1), ("u1", "new", at(2), 2), ("u3", "x", at(1), 3), ("u4", "y", at(1), 4),
         ("u4", "z", at(1), 5)], "url string, name string, event_time timestamp_ntz, event_id long")
    once = state.upsert_repositories(known, batch)
    assert rows(once.filter("id < 10"), "id", "name", "url", "created_at", "updated_at") == {
        (7, "new", "u1", at(0), at(2)), (9, "keep", "u2", at(0), at(0))}
    assert rows(once.filter("id > 9"), "name", "url") == {("x", "u3"), ("z", "u4")}
    assert {r.id for r in once.collect()} == {7, 9, 10, 11}
    twice = state.upsert_repositories(once, batch)
    assert rows(twice, *REPOSITORIES_NAMES) == rows(once, *REPOSITORIES_NAMES)


REPOSITORIES_NAMES = ["id", "name", "url", "created_at", "updated_at"]


def test_upsert_branches_sets_one_default(spark):
    known = spark.createDataFrame([(1, 1, "main", True, "a", "a", at(0), at(0)),
                                   (2, 2, "dev", False, "a", "a", at(0), at(0))], BRANCHES)
    batch = spark.createDataFrame(
        [(1, "dev", "s1", at(1), 1), (1, "main", "s2", at(2), 2), (2, "zeta", "s3", at(1), 3),
         (2, "alpha", "s4", at(1), 4), (2, "dev", "s5", at(0), 5), (3, "b", "s6", at(3), 6),
         (3, "a", "s7", at(4), 7)],
        "repository_id long, name string, head_commit_sha string, event_time timestamp_ntz, event_id long")
    got = state.upsert_branches(known, batch)
    assert rows(got, "repository_id", "name", "is_default", "last_seen_commit_sha") == {
        (1, "main", True, "s2"), (1, "dev", False, "s1"), (2, "dev", False, "s5"),
        (2, "alpha", True, "s4"), (2, "zeta", False, "s3"), (3, "b", True, "s6"), (3, "a", False, "s7")}
    assert quality.one_default_branch(got).count() == 0
    again = state.upsert_branches(got, batch)
    assert rows(again, *got.columns) == rows(got, *got.columns)


METRICS = ("repository_id long, branch_id long, scan_run_id long, date date, file_count int, "
           "class_count int, method_count int, dependency_count int")


def test_daily_metrics_nulls_are_equal(spark):
    day = dt.date(2026, 1, 1)
    known = spark.createDataFrame([(1, None, 1, day, 1, 1, 1, 0), (1, 5, 1, day, 2, 2, 2, 0)], METRICS)
    batch = spark.createDataFrame([(1, None, 3, day, 7, 7, 7, 0), (1, None, 2, day, 6, 6, 6, 0),
                                   (2, None, 4, day, 8, 8, 8, 0)], METRICS)
    got = state.upsert_daily_metrics(known, batch)
    assert rows(got, "repository_id", "branch_id", "scan_run_id", "file_count") == {
        (1, None, 3, 7), (1, 5, 1, 2), (2, None, 4, 8)}


def test_first_link_wins(spark):
    schema = "id long, repository_id long, branch_id long, commit_id long, first_seen_at timestamp_ntz"
    known = spark.createDataFrame([(1, 1, 1, 1, at(0))], schema)
    batch = spark.createDataFrame([(1, 1, 1, at(5)), (1, 1, 2, at(3)), (1, 1, 2, at(2))],
                                  "repository_id long, branch_id long, commit_id long, "
                                  "first_seen_at timestamp_ntz")
    got = state.link_branch_commits(known, batch)
    assert rows(got, "id", "commit_id", "first_seen_at") == {(1, 1, at(0)), (2, 2, at(2))}


def test_assigned_ids_are_dense_and_stable(spark):
    new = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("url"))
    used = spark.createDataFrame([(41,)], "id long")
    first = {r.url: r.id for r in state.assign_ids(new, ["url"], used).collect()}
    again = {r.url: r.id for r in state.assign_ids(new.repartition(7), ["url"], used).collect()}
    assert first == again
    assert sorted(first.values()) == list(range(42, 5042))


def test_scan_runs_complete_and_fail(spark):
    empty = Catalogue(spark, "").empty("scan_runs")
    started = spark.createDataFrame(
        [(i, 1, 1, "sha", "manual", at(i)) for i in (1, 2, 3)],
        "id long, repository_id long, branch_id long, head_commit_sha string, trigger_type string, "
        "started_at timestamp_ntz")
    running = state.start_scan_runs(state.start_scan_runs(empty, started), started)
    done = spark.createDataFrame([(1, at(2), None), (2, at(3), "boom")],
                                 "id long, completed_at timestamp_ntz, error_message string")
    got = state.complete_scan_runs(running, done)
    assert rows(got, "id", "status", "completed_at", "error_message") == {
        (1, "completed", at(2), None), (2, "failed", at(3), "boom"), (3, "running", None, None)}


def test_latest_scan_order_and_null_branch(spark):
    repos = spark.createDataFrame([(1, "a", "u1", at(0), at(0)), (2, "b", "u2", at(0), at(9)),
                                   (3, "c", "u3", at(0), at(0))], REPOSITORIES)
    scans = spark.createDataFrame(
        [(1, 1, 5, "x", "completed", at(1), at(4)), (2, 1, 6, "y", "running", at(4), None),
         (3, 3, 7, "z", "pending", at(2), None)],
        "id long, repository_id long, branch_id long, head_commit_sha string, status string, "
        "started_at timestamp_ntz, completed_at timestamp_ntz")
    day = dt.date(2026, 1, 1)
    metrics = spark.createDataFrame(
        [(1, 6, 2, day, 3, 2, 1, 0), (1, 5, 1, day, 9, 9, 9, 0), (2, None, None, day, 4, 4, 4, 0),
         (3, None, None, day, 5, 5, 5, 0)], METRICS)
    branches = spark.createDataFrame([(5, 1, "p", True, None, None, at(0), at(0)),
                                      (6, 1, "q", False, None, None, at(0), at(0))], BRANCHES)
    got = [(r.id, r.branch_count, r.latest_branch, r.latest_scan_run_id, r.file_count)
           for r in summary.list_repositories(repos, branches, scans, metrics).collect()]
    # Scan 2 ties with scan 1 in time and wins by id; no scan matches null-branch metrics only.
    assert got == [(2, 0, None, None, 4), (1, 2, "q", 2, 3), (3, 0, None, 3, 0)]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b"]), st.text("abc/", max_size=6)),
                max_size=60, unique=True))
def test_rank_in_group_is_row_number(spark, pairs):
    df = spark.createDataFrame(pairs, "g string, p string")
    got = {(r.g, r.p): r["rank"] for r in rank_in_group(df, "g", "p", buckets=5).collect()}
    expected = {}
    for g in {g for g, _ in pairs}:
        for i, p in enumerate(sorted(p for h, p in pairs if h == g), 1):
            expected[(g, p)] = i
    assert got == expected


@pytest.fixture(scope="module")
def catalogue(spark):
    from srcstrata.session import configure, stored
    c = Catalogue(configure(spark), "/root/testdata/sf0.001")
    return {name: stored(df, name) for name, df in c.tables().items()}, c


def test_after_a_cascade_no_child_is_left(spark, catalogue):
    tables, c = catalogue
    before = {tuple(r) for r in quality.foreign_key_violations(tables).collect()}
    left, unknown = cascade.delete_repositories(tables, c.delete_ids)
    assert [r.id for r in unknown.collect()] == [-1]
    after = {tuple(r) for r in quality.foreign_key_violations(left).collect()}
    assert after <= before
    gone = {r.id for r in c.delete_ids.collect()}
    for name, df in left.items():
        if "repository_id" in df.columns:
            assert not gone & {r.repository_id for r in df.select("repository_id").distinct().collect()}
        assert df.count() <= tables[name].count()


def test_deleting_branches_empties_or_cascades(spark, catalogue):
    tables, c = catalogue
    ids = tables["branches"].filter("name = '2-HIGH'").select("id")
    dead = {r.id for r in ids.collect()}
    left, unknown = cascade.delete_branches(tables, ids)
    assert unknown.count() == 0
    for name in ("source_files", "repository_metrics", "risk_scores", "technical_debt", "classes",
                 "methods", "dependencies"):
        assert left[name].count() == tables[name].count()
    for name, df in left.items():
        if "branch_id" in df.columns:
            assert not dead & {r.branch_id for r in df.select("branch_id").distinct().collect()}
    scans = {r.id for r in tables["scan_runs"].join(
        ids.withColumnRenamed("id", "branch_id"), "branch_id", "left_semi").collect()}
    for name in ("file_changes", "analysis_artifacts", "source_files", "risk_scores"):
        assert not scans & {r.scan_run_id for r in left[name].select("scan_run_id").collect()}


def test_all_violations_is_the_sum_of_its_parts(spark, catalogue):
    tables, _ = catalogue
    report = quality.all_violations(tables)
    assert report.columns == quality.COLUMNS
    assert {"commits", "scan_runs", "file_changes"} <= {
        r.table_name for r in report.select("table_name").distinct().collect()}


def test_a_null_check_passes(spark):
    changes = spark.createDataFrame(
        [(1, "a", None, None, None, 1, None)],
        "scan_run_id long, path string, old_path string, change_type string, additions int, "
        "deletions int, patch_uri string")
    assert quality.check_constraints({"file_changes": changes}).count() == 0
    assert rows(quality.not_null_violations({"file_changes": changes}), "rule") == {
        ("change_type_required",), ("additions_required",)}


def test_batches_may_be_cut_anywhere(spark):
    """The first event of a key counts as its first, however events are cut into batches."""
    from datetime import datetime

    from srcstrata.operators import state

    def day(n):
        return datetime(2024, 1, n)
    events = spark.createDataFrame(
        [("u", "a", day(1), 1), ("u", "b", day(9), 2), (None, "c", day(3), 3), (None, "d", day(2), 4)],
        "url string, name string, event_time timestamp, event_id long")
    empty = spark.createDataFrame([], "id long, url string, name string, created_at timestamp, updated_at timestamp")
    whole = state.upsert_repositories(empty, events)
    parts = empty
    for n in (2, 3, 4, 10):
        since = events.filter(f"day(event_time) < {n} and day(event_time) >= {({2: 0, 3: 2, 4: 3, 10: 4})[n]}")
        parts = state.upsert_repositories(parts, since)
    shown = ["url", "name", "created_at", "updated_at"]
    assert sorted(map(str, whole.select(shown).collect())) == sorted(map(str, parts.select(shown).collect()))
    assert {r.url: r.created_at for r in whole.collect()} == {"u": day(1), None: day(2)}


def test_row_rules_filter_before_hits_are_built(spark, capsys):
    made = spark.createDataFrame([(1, None, "u", T0, T0), (2, "b", None, None, T0), (3, "c", "u", T0, T0)], REPOSITORIES)
    found = quality.not_null_violations({"repositories": made})
    assert rows(found, "rule", "key") == {("name_required", "1"), ("url_required", "2"), ("created_at_required", "2")}
    found.explain()
    plain = [line for line in capsys.readouterr().out.splitlines() if "Filter" in line and "array(" not in line]
    assert any("isnull(name" in line and " OR " in line for line in plain)
