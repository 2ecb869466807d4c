"""A stream of finished scans into the catalogue tables.

Every micro-batch becomes one version of the tables (``sources.versions``),
together with its number in the version's ledger: a batch that is run again
after a restart finds its number and changes nothing.

The tables keep, next to their declared columns, the time and id of the event
that set a row's values. An event changes values only if it is later than that,
and first times only if it is earlier, so a table does not depend on how events
are cut into batches, on late events or on events that come twice. Two things
follow the order of arrival, as they do in the service: the surrogate ids, and
which branch became a repository's default.

A batch reads and writes the buckets of the repositories it names and no
others; what is larger than the batch is never shuffled whole. Only the
repositories' ids are read whole, for the next id. A table's files are written
once, ahead of the commit that names them, and later steps read these. Where a
table has no rows in the batch's buckets, as in a first load, there is nothing
to compare with, and rows are written as the numbering has placed them. Between
steps go the columns that are needed later: files are looked up for the scans
that give them, not carried along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from srcstrata.operators import state
from srcstrata.operators.relational import null_safe_join, top1_per_group
from srcstrata.operators.summary import default_branch_flag
from srcstrata.operators.symbols import file_key
from srcstrata.schemas import TABLES
from srcstrata.session import stored
from srcstrata.sources.versions import Change, VersionedTables, Written

# One row per finished scan; files are those of the branch, null for a failed scan.
EVENT_COLUMNS = ["scan_run_id", "url", "name", "branch_name", "head_commit_sha", "author_name", "author_email", "message",
                 "committed_at", "trigger_type", "error_message", "event_time", "files"]
CLOCK = ["event_time", "event_id"]
# Parts of a bucket that new rows are numbered in, and so the files a first load gives a bucket at most.
PARTS = 16
STATE_TABLES = ["repositories", "commits", "branches", "branch_commits", "scan_runs", "source_files",
                "repository_metrics"]


def declared(name: str, rows: DataFrame) -> DataFrame:
    """The columns of the catalogue table, without the clock."""
    return rows.select(*TABLES[name].names)


def read_state(store: VersionedTables, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of a version; empty ones before the first."""
    held = store.manifest(version)
    return {name: declared(name, store.read(name, manifest=held)) for name in STATE_TABLES}


def _empty(name: str, events: DataFrame) -> DataFrame:
    """An empty table with a clock, its times of the kind that the events have."""
    time = events.schema["event_time"].dataType
    schema = TABLES[name].schema
    rows = events.sparkSession.createDataFrame([], schema)
    return rows.select(*[F.col(f.name).cast(time) if f.dataType.typeName() == "timestamp" else F.col(f.name)
                         for f in schema], F.lit(None).cast(time).alias("event_time"),
                       F.lit(None).cast("long").alias("event_id"))


def upsert_ordered(table: DataFrame, batch: DataFrame, keys: Sequence[str], values: dict[str, Column], first: str | None,
                   name: str, fresh=None, ids: DataFrame | None = None, bucket: Column | None = None,
                   held: bool = True, repeated: DataFrame | None = None) -> DataFrame:
    """``table`` after a batch of events, whatever their order.

    ``values`` are what the last event of a key sets, in terms of its columns;
    ``first`` is a time column that keeps the key's earliest event. New keys get
    the columns that ``fresh(table, rows)`` adds, and an id above those of ``ids``,
    numbered by ``bucket``. ``held`` is false where the table is known to be empty.
    ``repeated``, where given, has the keys of several rows: the other rows need no grouping.
    """
    order = F.struct(*CLOCK)
    keyed = batch.select(*keys, *CLOCK, *[v.alias(c) for c, v in values.items()])
    grouped = keyed if repeated is None else null_safe_join(keyed, repeated, keys, "left_semi")
    last = grouped.groupBy(*keys).agg(F.max_by(F.struct(*CLOCK, *values), order).alias("__last"),
                                      F.min("event_time").alias("__first")).select(*keys, "__last.*", "__first")
    if repeated is not None:
        last = null_safe_join(keyed, repeated, keys, "left_anti").withColumn("__first", F.col("event_time")).unionByName(last)
    if not held:
        new = last if fresh is None and ids is None else stored(last, f"batch-{name}", "zstd")
    else:
        rows = state.tagged(table, last, keys, name)
        new = rows.filter("__known IS NULL")
    if fresh is not None:
        new = fresh(table, new)
    if ids is not None:
        new = state.assign_ids(new, keys, ids, bucket=bucket)
    if first:
        new = new.withColumn(first, F.col("__first"))
    if not held:
        return new.select(*table.columns)
    later = F.struct(*[F.col(f"new_{c}") for c in CLOCK]) > F.struct(*CLOCK)
    updates = {c: F.when(later, F.col(f"new_{c}")).otherwise(F.col(c)) for c in [*CLOCK, *values]}
    if first:
        updates[first] = F.least(F.col(first), F.col("new___first"))
    return state.merge(table, rows.filter("__known").drop("__known"), keys, updates, new)


def apply_scans(store: VersionedTables, events: DataFrame, ledger: dict[str, int] | None = None) -> int | None:
    """Adds finished scans to the tables as one new version; None if the ledger says they are in already."""
    held = store.manifest()
    if ledger and all(held["ledger"].get(stream, -1) >= batch for stream, batch in ledger.items()):
        return None
    events = stored(events.select(*EVENT_COLUMNS), "events", "zstd").withColumn("event_id", F.col("scan_run_id"))
    schemas = {n: _empty(n, events).schema for n in STATE_TABLES}
    changes: dict[str, Written] = {}

    def part(name: str, buckets: tuple[int, ...]) -> DataFrame:
        return store.read(name, buckets=buckets, manifest=held, schema=schemas[name])

    def changed(name: str, after: DataFrame, buckets: tuple[int, ...], placed: bool = False) -> DataFrame:
        changes[name] = store.write(name, Change(after.select(*schemas[name].names), buckets, placed), held)
        return store.written(changes[name])

    def upserted(name: str, table: DataFrame, batch: DataFrame, keys: Sequence[str], values: dict[str, Column],
                 first: str | None, buckets: tuple[int, ...], numbered: bool = True, fresh=None,
                 repeated: DataFrame | None = None) -> DataFrame:
        known = store.holds(name, buckets, held)
        ids = store.read(name, manifest=held, schema=schemas[name]).select("id") if numbered else None
        # Parts of the table's buckets: rows that were numbered in them need no further shuffle, however large a bucket is.
        parts = store.bucket(name) * PARTS + F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")
        after = upsert_ordered(table, batch, keys, values, first, name.replace("_", "-"), fresh, ids, parts, known,
                               repeated)
        return changed(name, after, buckets, placed=numbered and not known)

    buckets = store.touched("repositories", events)
    repositories = upserted(
        "repositories", part("repositories", buckets), events, ["url"],
        {"name": F.col("name"), "updated_at": F.col("event_time")}, "created_at", buckets)
    scans = stored(events.withColumn("n_files", F.size("files")).drop("event_id", "files", "name").join(
        repositories.select("url", F.col("id").alias("repository_id")), "url").drop("url"), "scans", "zstd").withColumn(
        "event_id", F.col("scan_run_id"))

    buckets = store.touched("commits", scans)
    commits = upserted(
        "commits", part("commits", buckets), scans.withColumn("sha", F.col("head_commit_sha")), ["repository_id", "sha"],
        {c: F.col(c) for c in ("author_name", "author_email", "message", "committed_at")}, "discovered_at", buckets)

    branches = upserted(
        "branches", part("branches", buckets), scans.withColumn("name", F.col("branch_name")), ["repository_id", "name"],
        {"last_seen_commit_sha": F.col("head_commit_sha"), "last_scanned_commit_sha": F.col("head_commit_sha"),
         "updated_at": F.col("event_time")}, "created_at", buckets,
        fresh=lambda table, rows: default_branch_flag(table, rows.withColumn("first_seen_at", F.col("__first"))))

    scans = stored(
        scans.select("scan_run_id", "repository_id", "branch_name", "head_commit_sha", "trigger_type", "error_message",
                     "event_time", "n_files")
        .join(branches.select("repository_id", F.col("name").alias("branch_name"), F.col("id").alias("branch_id")),
              ["repository_id", "branch_name"]).drop("branch_name"), "scans", "zstd").withColumn(
        "event_id", F.col("scan_run_id")).withColumn(
        "status", F.when(F.col("error_message").isNull(), "completed").otherwise("failed"))

    linked = scans.select("repository_id", "branch_id", "head_commit_sha", *CLOCK).join(
        commits.select("repository_id", F.col("sha").alias("head_commit_sha"), F.col("id").alias("commit_id")),
        ["repository_id", "head_commit_sha"])
    upserted("branch_commits", part("branch_commits", buckets), linked, ["branch_id", "commit_id"],
             {"repository_id": F.col("repository_id")}, "first_seen_at", buckets)

    # A scan's event seldom comes twice in a batch; the ids alone tell, and are stored, so that few are broadcast.
    repeated = stored(scans.groupBy(F.col("scan_run_id").alias("id")).count().filter("count > 1").select("id"), "repeated")
    runs = part("scan_runs", buckets)
    before = _last_completed(runs.withColumnRenamed("id", "scan_run_id"))
    upserted(
        "scan_runs", runs, scans.withColumn("id", F.col("scan_run_id")), ["id"],
        {**{c: F.col(c) for c in ("repository_id", "branch_id", "head_commit_sha", "status", "trigger_type",
                                  "error_message")},
         "base_commit_sha": F.lit(None).cast("string"), "started_at": F.col("event_time"),
         "completed_at": F.col("event_time")}, None, buckets, numbered=False, repeated=repeated)

    # Of the completed scans of a branch, stored and new, the last one gives the files.
    completed = scans.filter("status = 'completed'")
    newest = _last_completed(completed)
    stale = before.withColumnsRenamed({"scan_run_id": "old_id", "event_time": "old_time"})
    last = null_safe_join(newest, stale, ["repository_id", "branch_id"], "left").filter(
        F.col("old_time").isNull() | (F.struct("event_time", "scan_run_id") > F.struct("old_time", "old_id")))
    last = stored(last.select("repository_id", "branch_id", "scan_run_id", "event_time"), "last-scans", "zstd")
    given = null_safe_join(events.filter("error_message IS NULL").select("scan_run_id", "event_time", "files"), last,
                           ["scan_run_id", "event_time"], "inner").dropDuplicates(
        ["scan_run_id", "event_time", "repository_id", "branch_id"])
    # A scan's files are dealt out as one row, and keyed where they are written.
    found = (store.place("source_files", given)
             .select("repository_id", "branch_id", "scan_run_id", "event_time", F.explode("files").alias("f"))
             .select("repository_id", "branch_id", "scan_run_id", "event_time", "f.path", "f.language", "f.loc")
             .withColumn("event_id", F.col("scan_run_id")).withColumn("file_key", file_key()))
    files = part("source_files", buckets)
    kept = state.replace_branch_files(files, files.limit(0), last)
    changed("source_files", store.place("source_files", kept).unionByName(found.select(*files.columns)), buckets, placed=True)

    counted = completed.withColumn("date", F.to_date("event_time")).withColumn(
        "file_count", F.coalesce("n_files", F.lit(0)))
    upserted(
        "repository_metrics", part("repository_metrics", buckets), counted, ["repository_id", "branch_id", "date"],
        {"scan_run_id": F.col("scan_run_id"), "file_count": F.greatest("file_count", F.lit(0)), "class_count": F.lit(0),
         "method_count": F.lit(0), "dependency_count": F.lit(0)}, None, buckets, numbered=False)
    return store.commit(changes, ledger, held)


def _last_completed(runs: DataFrame) -> DataFrame:
    """(repository_id, branch_id, scan_run_id, event_time) of the last completed scan of every branch."""
    return top1_per_group(runs.filter("status = 'completed'"), ["repository_id", "branch_id"], [
        F.col("event_time").desc(), F.col("scan_run_id").desc()]).select(
        "repository_id", "branch_id", "scan_run_id", "event_time")


def start_scan_state(events: DataFrame, store: VersionedTables, checkpoint: str, stream: str = "scans") -> StreamingQuery:
    """Follows a stream of finished scans until what is there is read; ``stream`` names it in the ledger."""
    def write(batch: DataFrame, batch_id: int) -> None:
        apply_scans(store, batch, {stream: batch_id})

    return (events.select(*EVENT_COLUMNS).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
            .trigger(availableNow=True).start())
