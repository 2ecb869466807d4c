"""Diffs and searches against brute force; streams against batch."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcstrata.operators import diff, search
from srcstrata.streaming import scan_events


def brute_diff(base, head):
    """The definition, one file at a time."""
    def lines(text):
        parts = text.split("\n")
        return parts[:-1] if parts[-1] == "" else parts

    out = set()
    come = sorted(p for p in head if p not in base)
    gone = sorted(p for p in base if p not in head)
    pairs = {}
    for text in set(head.values()):
        new, old = [p for p in come if head[p] == text], [p for p in gone if base[p] == text]
        pairs.update(zip(new, old))
    for path in head:
        if path in base and head[path] != base[path]:
            a, b = Counter(lines(head[path])), Counter(lines(base[path]))
            out.add((path, None, "modified", sum((a - b).values()), sum((b - a).values())))
        elif path in pairs:
            out.add((path, pairs[path], "renamed", 0, 0))
        elif path not in base:
            same = sorted(p for p in base if base[p] == head[path])
            out.add((path, same[0], "copied", 0, 0) if same
                    else (path, None, "added", len(lines(head[path])), 0))
    for path in gone:
        if path not in pairs.values():
            out.add((path, None, "deleted", 0, len(lines(base[path]))))
    return out


CASES = [
    ({"a": "x\ny\n", "b": "x"}, {"a": "x\nz\nz", "b": "x"}),
    ({"a": "same", "b": "same", "c": "same"}, {"d": "same", "e": "same", "f": "same", "g": "same"}),
    ({"a": "1", "k": "1"}, {"k": "1", "m": "1", "n": "2"}),
    ({"a": "", "b": "\n"}, {"a": "\n", "b": ""}),
    ({}, {"a": "x"}), ({"a": "x"}, {}), ({}, {}),
    ({f"old/{i}": str(i % 3) for i in range(40)}, {f"new/{i}": str(i % 4) for i in range(50)}),
]


@pytest.mark.parametrize("base, head", CASES)
def test_diff_is_the_definition(spark, base, head):
    def frame(tree):
        return spark.createDataFrame(list(tree.items()), "path string, content string")
    got = {tuple(r) for r in diff.snapshot_file_changes(frame(base), frame(head)).select(
        "path", "old_path", "change_type", "additions", "deletions").collect()}
    assert got == brute_diff(base, head)


def test_topk_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(500, 16))
    vectors[100:300] = vectors[7]  # a hot group of equal vectors is ordered by id
    vectors[42] = 0
    queries = np.vstack([rng.normal(size=(6, 16)), vectors[7], np.zeros(16)])
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)],
                              "vec_id long, embedding array<double>").repartition(7)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(queries)],
                              "query_id long, embedding array<double>")
    monkeypatch.setattr(search, "REQUESTS_PER_BLOCK", 3)
    monkeypatch.setattr(search, "VECTORS_PER_PASS", 17)
    got = {}
    for r in search.semantic_topk(q, v, 4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    expected = {}
    for i, query in enumerate(queries[:-1]):
        scores = [(-(x * query).sum() / (np.sqrt((x * x).sum()) * np.sqrt((query * query).sum())), j)
                  for j, x in enumerate(vectors) if j != 42]
        expected[i] = {n: j for n, (_, j) in enumerate(sorted(scores)[:4], 1)}
    assert got == expected


def test_topk_reads_the_vectors_once_and_takes_odd_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, []), (5, [0.5, 0.5]), (6, [None, 1.0])],
                              "vec_id long, embedding array<double>")
    q = spark.range(10_000).selectExpr("id as query_id", "array(1D, cast(id as double)) as embedding").unionByName(
        spark.createDataFrame([(-1, None), (-2, [2.0]), (-3, [])], "query_id long, embedding array<double>"))
    found = search.semantic_topk(q, v, 1)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r.query_id: r.vec_id for r in found.collect()}
    assert len(got) == 10_001 and got[-2] == 2 and got[0] == 1 and got[1] == 5
    assert search.semantic_topk(q.limit(0), v, 1).count() == 0


def plan_without_broadcast(spark, make):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()._jdf.queryExecution().optimizedPlan(), make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_no_text_is_shuffled_by_a_diff(spark, tmp_path):
    spark.createDataFrame([("a", "x\ny"), ("b", "z")], "path string, content string").write.parquet(str(tmp_path / "t"))
    base = spark.read.parquet(str(tmp_path / "t"))
    head = base.selectExpr("path", "concat(content, 'w') as content")
    _, plan = plan_without_broadcast(spark, lambda: diff.snapshot_file_changes(base, head))
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("content" in line for line in exchanges)
    # What an exchange carries is what its child puts out: no projection below one keeps a text.
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            assert "content" not in lines[i + 1].split("Batched")[0].split("xxhash64")[0]


def test_few_tokens_that_are_no_names_are_shuffled(spark):
    from srcstrata.operators import symbols
    words = "' '.join"  # many words, few names
    files = spark.range(50).selectExpr(
        "1L as repository_id", "1L as branch_id", "concat('f', id, '.java') as path", "'Java' as language",
        "concat('class C', id, ' {\n', concat_ws(' ', transform(sequence(1, 400), i -> concat('w', id, '_', i))), ' C', "
        "(id + 1) % 50) as content")
    named = search.file_names(symbols.with_lines(files))
    edges = search.class_dependencies(named)
    assert words and edges.count() == 50
    uses = named.selectExpr("repository_id", "branch_id", "explode(tokens) as target_class")
    from srcstrata.operators.bitmap import bitmap, maybe_in
    names = named.selectExpr("repository_id", "branch_id", "explode(class_names) as target_class")
    key = ("repository_id", "branch_id", "target_class")
    kept = maybe_in(uses, bitmap(names, *key), *key).count()
    assert uses.count() > 20_000 and 100 <= kept <= 200


def test_symbol_search_is_case_sensitive(spark):
    schema = "repository_id long, branch_id long, path string, name string"
    classes = spark.createDataFrame([(1, 1, "a", "Foo"), (1, 1, "a", "foo")], schema)
    methods = spark.createDataFrame([(1, 1, "a", "food"), (1, 1, "a", "xfoo")], schema)
    got = {(r.kind, r.name) for r in search.symbol_search(classes, methods, "foo").collect()}
    assert got == {("class", "foo"), ("method", "food")}


EVENTS = ("scan_run_id long, repository_id long, head_commit_sha string, status string, "
          "trigger_type string, started_at timestamp")


@pytest.fixture
def events(spark):
    raw = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    return raw.selectExpr("event_id as scan_run_id", "user_id as repository_id",
                          "md5(event_type) as head_commit_sha", "event_type as status",
                          "'webhook' as trigger_type", "cast(ts as timestamp) as started_at")


def write_slice(df, folder, name):
    df.coalesce(1).write.mode("append").parquet(os.path.join(folder, name))


def test_latest_scan_stream_equals_batch(spark, events, tmp_path):
    source, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "checkpoint"))
    os.makedirs(source)
    stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(source)
    cuts = events.selectExpr("percentile(unix_timestamp(started_at), array(0.3, 0.7)) as p").first().p
    seconds = F.unix_timestamp("started_at")
    slices = [events.filter(seconds < cuts[0]), events.filter((seconds >= cuts[0]) & (seconds < cuts[1])),
              events.filter(seconds >= cuts[1]),
              events.filter(seconds < cuts[0])]  # late, and replayed: must change nothing
    results = []
    for i, part in enumerate(slices):
        write_slice(part, source, f"s{i}")
        scan_events.start_latest_scans(stream, log, checkpoint).awaitTermination()
        results.append({tuple(r) for r in scan_events.read_latest_scans(spark, log).collect()})
    newest = {}
    for r in events.collect():
        if r.repository_id not in newest or (r.started_at, r.scan_run_id) > newest[r.repository_id][:2]:
            newest[r.repository_id] = (r.started_at, r.scan_run_id, tuple(r))
    assert results[2] == results[3] == {e[2] for e in newest.values()}


def test_daily_counts_close_once_and_drop_late_scans(spark, events, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    os.makedirs(source)
    stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(source)
    cut = events.selectExpr("percentile(unix_timestamp(started_at), 0.5) as p").first().p
    early = events.filter(F.unix_timestamp("started_at") < cut)
    parts = [early, early.limit(5), events.filter(F.unix_timestamp("started_at") >= cut), early]
    for i, part in enumerate(parts):
        write_slice(part, source, f"s{i}")
        scan_events.start_daily_counts(stream, out, checkpoint).awaitTermination()
    got = {r.day: r.scans for r in spark.read.parquet(out).collect()}
    assert len(got) == spark.read.parquet(out).count()
    newest = max(r.started_at for r in events.collect())
    days = Counter(r.started_at.date() for r in events.collect())
    import datetime as dt
    closed = {d: n for d, n in days.items()
              if dt.datetime.combine(d, dt.time()) + dt.timedelta(days=2) <= newest}
    assert got == closed


def test_one_hot_group_of_equal_files_is_paired_whole(spark):
    """A third of all files are equal and all of them move."""
    n = 6000
    old = spark.range(n).selectExpr("concat('old/', lpad(id, 6, '0')) as path",
                                    "case when id % 3 = 0 then 'same' else cast(id as string) end as content")
    new = spark.range(n).selectExpr("concat('new/', lpad(id, 6, '0')) as path",
                                    "case when id % 3 = 0 then 'same' else cast(id as string) end as content")
    changes = diff.snapshot_file_changes(old, new)
    wrong = changes.filter("change_type <> 'renamed' or substr(path, 5) <> substr(old_path, 5)")
    assert changes.count() == n and wrong.count() == 0


def test_a_hot_class_name_is_not_multiplied(spark):
    from srcstrata.operators import symbols
    n = 400
    files = spark.range(n).selectExpr(
        "1L as repository_id", "1L as branch_id", "concat('f', id, '.java') as path", "'Java' as language",
        "'class Hot {' as content")
    named = search.file_names(symbols.with_lines(files))
    edges = search.class_dependencies(named)
    assert edges.count() == n
    assert search.dependency_counts(edges).first().dependency_count == n * (n - 1)
