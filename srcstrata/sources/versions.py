"""Catalogue tables as versions: hash-bucketed files under a manifest that one rename commits.

    <root>/data/<table>/<write>/bucket=<n>/part-*.parquet
    <root>/versions/<version>.json

A version's manifest names, per table and bucket, the folder that holds its
rows, the table's schema, and the last batch of every stream that is part of it.
A write brings new folders for the buckets it touches and takes the others over
from the version before, so the files of a write are bounded by what it touches.
Nobody reads a folder that no manifest names: a writer that fails before its
rename leaves the old version, and of two writers of one version the second
fails (:class:`VersionTaken`). Old versions stay readable until :meth:`expire`.

A bucket may be of any size: its rows are dealt out to tasks as adaptive
execution sees fit, so a repository with a third of all rows is many files in
one folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcstrata.operators.state import replace_branch_files
from srcstrata.schemas import TABLES
from srcstrata.session import stored

# What a table is bucketed by: the repository, where its rows name one.
BUCKET_BY = {name: "url" if name == "repositories" else "scan_run_id" if name == "file_changes" else "repository_id"
             for name in TABLES}


class VersionTaken(RuntimeError):
    """Another writer has committed the version this one was made for."""


@dataclass(frozen=True)
class Change:
    """New rows of the named buckets; all their old rows go.

    ``placed`` says that a shuffle has put the rows of a bucket into few tasks already.
    """

    rows: DataFrame
    buckets: tuple[int, ...]
    placed: bool = False


@dataclass(frozen=True)
class Written:
    """A change whose rows are in files; no reader sees them before a commit names their folders."""

    schema: T.StructType
    buckets: tuple[int, ...]
    folders: dict[str, str]


class VersionedTables:
    """Tables of one root folder that every executor can reach."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, bucket_by: dict[str, str] | None = None):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.bucket_by = BUCKET_BY if bucket_by is None else bucket_by
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._fs.makeQualified(self._path(self.root)).toUri(), conf)

    # --- versions

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int:
        """The newest version; 0, without any table, before the first commit."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        if version == 0:
            return {"version": 0, "buckets": self.buckets, "tables": {}, "ledger": {}}
        path = f"{self.root}/versions/{version}.json"
        with_text = self.spark.read.text(path, wholetext=True).first()
        held = json.loads(with_text[0])
        if held["buckets"] != self.buckets:
            raise ValueError(f"{self.root} has {held['buckets']} buckets")
        return held

    # --- reading

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(self.bucket_by[name]), F.lit(self.buckets)).cast("int")

    def touched(self, name: str, rows: DataFrame) -> tuple[int, ...]:
        """Buckets of a table that ``rows``, which have its bucket column, fall into: ``buckets`` numbers at most."""
        found = rows.select(self.bucket(name).alias("bucket")).distinct().collect()
        return tuple(sorted(r[0] for r in found))

    def read(self, name: str, version: int | None = None, buckets: Iterable[int] | None = None,
             manifest: dict | None = None, schema: T.StructType | None = None) -> DataFrame:
        """A table, or some of its buckets; empty, with ``schema`` or the declared one, where it never was written."""
        held = (manifest or self.manifest(version))["tables"].get(name)
        if held is None:
            return self._empty(schema or TABLES[name].schema)
        schema = T.StructType.fromJson(held["schema"])
        wanted = None if buckets is None else set(buckets)
        folders = [folder for b, folder in sorted(held["folders"].items(), key=lambda x: int(x[0]))
                   if wanted is None or int(b) in wanted]
        return self._files(schema, folders)

    def holds(self, name: str, buckets: Iterable[int], manifest: dict) -> bool:
        """Whether a version has rows of a table in any of the buckets."""
        held = manifest["tables"].get(name, {"folders": {}})["folders"]
        return any(str(b) in held for b in buckets)

    def _files(self, schema: T.StructType, folders: Iterable[str]) -> DataFrame:
        paths = [f"{self.root}/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self._empty(schema)

    def _empty(self, schema: T.StructType) -> DataFrame:
        """No rows, which the optimizer sees: what is joined with them is not shuffled."""
        return self.spark.createDataFrame([], schema).limit(0)

    # --- writing

    def replace_branches(self, rows: dict[str, DataFrame], scanned: DataFrame, ledger: dict[str, int] | None = None
                         ) -> int:
        """Replaces the files, classes or methods of every scanned (repository_id, branch_id) in one version.

        The scan list decides, so a branch scanned empty is cleared; other
        branches of a bucket that is touched are taken over.
        """
        base, changes = self.manifest(), {}
        scanned = stored(scanned.select("repository_id", "branch_id").distinct(), "scanned")
        for name, new in rows.items():
            buckets = self.touched(name, scanned)
            old = self.read(name, buckets=buckets, manifest=base, schema=new.schema)
            changes[name] = Change(replace_branch_files(old, new, scanned), buckets)
        return self.commit(changes, ledger, base)

    def replace(self, rows: DataFrame) -> Change:
        """A table's whole new content."""
        return Change(rows, tuple(range(self.buckets)))

    def place(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows``, which have the table's bucket column, dealt out by bucket."""
        return rows.withColumn("bucket", self.bucket(name)).hint("rebalance", "bucket").drop("bucket")

    def write(self, name: str, change: Change, base: dict) -> Written:
        """Writes a change's files ahead of the commit of the version after ``base``."""
        folder = f"data/{name}/{base['version'] + 1:09d}-{uuid.uuid4().hex[:12]}"
        return Written(change.rows.schema, change.buckets, self._write(name, change, folder))

    def written(self, change: Written) -> DataFrame:
        """The rows of a change whose files are written."""
        return self._files(change.schema, [f for _, f in sorted(change.folders.items())])

    def commit(self, changes: dict[str, Change | Written], ledger: dict[str, int] | None = None,
               base: dict | None = None) -> int:
        """Writes the changes and commits them as the version after ``base``; returns its number.

        All rows of a change must fall into its buckets. Raises
        :class:`VersionTaken` if there is such a version already.
        """
        base = base or self.manifest()
        version, write = base["version"] + 1, uuid.uuid4().hex[:12]
        tables = dict(base["tables"])
        for name, change in changes.items():
            held = tables.get(name, {"folders": {}})
            folders = {b: f for b, f in held["folders"].items() if int(b) not in set(change.buckets)}
            change = change if isinstance(change, Written) else self.write(name, change, base)
            folders.update(change.folders)
            tables[name] = {"schema": change.schema.jsonValue(), "folders": folders}
        self._commit({"version": version, "buckets": self.buckets, "tables": tables,
                      "ledger": {**base["ledger"], **(ledger or {})}}, write)
        return version

    def _write(self, name: str, change: Change, folder: str) -> dict[str, str]:
        """Writes the buckets and returns their folders; an empty bucket has none."""
        if not change.buckets:
            return {}
        rows = change.rows if change.placed else self.place(name, change.rows)
        (rows.withColumn("bucket", self.bucket(name)).write.option("partitionOverwriteMode", "static")
         .partitionBy("bucket").parquet(f"{self.root}/{folder}", compression="zstd"))
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/{folder}"))]
        found = {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith("bucket=")}
        stray = set(map(int, found)) - set(change.buckets)
        if stray:
            raise ValueError(f"rows of {name} outside of the buckets that change: {sorted(stray)}")
        return found

    def _commit(self, manifest: dict, write: str) -> None:
        ready = self._path(f"{self.root}/versions/_{manifest['version']}-{write}")
        with_version = self._path(f"{self.root}/versions/{manifest['version']}.json")
        stream = self._fs.create(ready, False)
        try:
            stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            stream.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(ready, with_version, options)
        except Py4JJavaError as failed:
            if "FileAlreadyExists" in failed.java_exception.getClass().getName():
                self._fs.delete(ready, False)
                raise VersionTaken(f"version {manifest['version']} of {self.root}") from failed
            raise

    def expire(self, keep: int) -> int:
        """Removes all versions but the newest ``keep``, and the folders that none of these names."""
        versions = self.versions()
        kept, gone = versions[-keep:], versions[:-keep]
        used = {f.rpartition("/")[0] for v in kept for t in self.manifest(v)["tables"].values()
                for f in t["folders"].values()}
        old = {f.rpartition("/")[0] for v in gone for t in self.manifest(v)["tables"].values()
               for f in t["folders"].values()}
        for version in gone:  # first the manifests, so that no version names a folder that is gone
            self._fs.delete(self._path(f"{self.root}/versions/{version}.json"), False)
        for folder in old - used:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
        return len(gone)
