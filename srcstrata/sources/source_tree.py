"""Source trees as DataFrames.

The built-in file sources drop names that start with ``_`` or ``.``, even when
listed explicitly, and such files are source files here (``__init__.py``).

Folders are listed by tasks, in rounds (:func:`list_entries`): a task lists the
folders dealt to it and goes on below them until it has listed its share; what
it has not entered by then is dealt out anew, until nothing is left. The driver
lists nothing, and neither the depth nor the size of a tree is fixed anywhere.
Every entry that is not read has a row with the reason. :func:`read_files` reads
listed files in tasks of about ``GROUP_BYTES``.

``spark.read.format("source_tree").option("path", root)`` reads one tree as well,
a task per folder below the root.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from srcstrata.functions.language import MAX_SOURCE_BYTES, SKIPPED_NAMES
from srcstrata.session import stored

SCHEMA = "path string, size long, content binary"
GROUP_BYTES = 64 * 1024 * 1024
BATCH_BYTES = 16 * 1024 * 1024
# Folders that a task lists in one round, and rows of a batch of entries.
FOLDERS_PER_TASK, ENTRIES = 256, 4096


def _local(root: str) -> str:
    """A path on a mounted file system without its ``file:`` scheme."""
    return root.removeprefix("file://").removeprefix("file:")


_SYSTEMS: dict = {}  # clients of this task


def _remote(root: str):
    """(file system, base path) for a URI such as s3:// or hdfs://; None for a mounted path."""
    if "://" not in root:
        return None
    if root not in _SYSTEMS:
        from pyarrow import fs
        system, base = fs.FileSystem.from_uri(root)
        _SYSTEMS[root] = system, base.rstrip("/")
    return _SYSTEMS[root]


def _entries(root: str, folder: str) -> Iterator[tuple[str, bool, int | None, str | None]]:
    """(name, is directory, size, reason) of one folder below the root.

    A reason says why the entry is not read: a skipped name, or a size that
    cannot be read. A symlink to a file counts as a file, one to a directory is
    no entry.
    """
    remote = _remote(root)
    if remote is not None:
        from pyarrow import fs
        system, base = remote
        where = f"{base}/{folder}".rstrip("/")
        for info in system.get_file_info(fs.FileSelector(where, recursive=False)):
            is_folder = info.type == fs.FileType.Directory
            if info.base_name in SKIPPED_NAMES:
                yield info.base_name, is_folder, None, "skipped folder"
            elif is_folder or info.type == fs.FileType.File:
                yield info.base_name, is_folder, None if is_folder else info.size or 0, None
        return
    with os.scandir(os.path.join(root, folder)) as found:
        for entry in found:
            try:
                is_folder = entry.is_dir(follow_symlinks=False)
                if entry.name in SKIPPED_NAMES:
                    yield entry.name, is_folder, None, "skipped folder"
                elif is_folder:
                    yield entry.name, True, None, None
                elif entry.is_file():
                    yield entry.name, False, entry.stat().st_size, None
                elif entry.is_symlink() and not os.path.exists(entry.path):
                    yield entry.name, False, None, "unreadable size"
            except OSError:
                yield entry.name, False, None, "unreadable size"


def _walk(root: str, folder: str) -> Iterator[tuple[str, int]]:
    """(relative path, size) of the files below a folder."""
    pending = [folder]
    while pending:
        here = pending.pop()
        for name, is_folder, size, reason in _entries(root, here):
            path = f"{here}/{name}" if here else name
            if reason is None:
                if is_folder:
                    pending.append(path)
                else:
                    yield path, size


def _read(root: str, path: str) -> bytes:
    remote = _remote(root)
    if remote is not None:
        system, base = remote
        with system.open_input_file(f"{base}/{path}") as stream:
            return stream.read()
    with open(os.path.join(root, path), "rb") as stream:
        return stream.read()


@dataclass
class TreePart(InputPartition):
    """Folders to walk and files already listed."""

    folders: tuple[str, ...] = ()
    files: tuple[tuple[str, int], ...] = ()


class SourceTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = _local(options["path"])
        self.cap = int(options.get("maxFileBytes", MAX_SOURCE_BYTES))

    def partitions(self) -> list[TreePart]:
        """The files of the root folder, and each folder in it."""
        here = [(n, d, size) for n, d, size, reason in _entries(self.root, "") if reason is None]
        return [TreePart(files=tuple((n, size) for n, d, size in here if not d)),
                *[TreePart(folders=(n,)) for n, d, _ in here if d]]

    def read(self, partition: TreePart) -> Iterator[tuple[str, int, bytes]]:
        walked = (found for folder in partition.folders for found in _walk(self.root, folder))
        for path, size in chain(partition.files, walked):
            if size <= self.cap:
                content = _read(self.root, path)
                yield path, len(content), content


class SourceTree(DataSource):
    """One source tree: path, size and bytes of its files up to the size cap."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SourceTreeReader:
        return SourceTreeReader(self.options)


def read_tree(spark: SparkSession, root: str, max_file_bytes: int = MAX_SOURCE_BYTES, **listing) -> DataFrame:
    """One tree: path, size and bytes of its files up to the size cap. An unreadable root fails the job."""
    roots = spark.createDataFrame([(root,)], "root string")
    entries = list_entries(roots, max_file_bytes, **listing)
    unreadable = F.col("reason").isin(UNREADABLE)
    checked = entries.withColumn("reason", F.when(unreadable, F.raise_error(F.concat_ws(": ", "reason", "root", "path")))
                                 .otherwise(F.col("reason"))).filter("reason IS NULL").drop("reason")
    return read_files(checked).select("path", F.octet_length("content").cast("long").alias("size"), "content")


def _tasks(df: DataFrame, partitions: int | None) -> int:
    """An explicit number: adaptive execution would merge these few bytes into one task."""
    return partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# Reasons that say that a scan has not seen its whole tree.
UNREADABLE = ["unreadable root", "unreadable folder"]


def list_entries(roots: DataFrame, max_file_bytes: int = MAX_SOURCE_BYTES, folders_per_task: int = FOLDERS_PER_TASK,
                 partitions: int | None = None) -> DataFrame:
    """Every entry of many trees: the columns of ``roots`` (with ``root``), path, size, reason.

    The reason is null for files to read; else ``skipped folder``, ``size``,
    ``unreadable size``, ``unreadable folder`` or ``unreadable root``, which touch
    their own tree only. Every round is stored, so a folder is listed once
    whatever reads the result. A root named by several rows is listed once for
    each distinct row.
    """
    roots = roots.distinct()
    keys = roots.columns
    tasks = _tasks(roots, partitions)
    kinds = roots.schema.add("folder", "string").add("path", "string").add("size", "long").add("reason", "string")
    arrow = [pa.string(), pa.string(), pa.int64(), pa.string()]

    def listed(root: str, folder: str):
        """(folder, path, size, reason) of one folder."""
        try:
            for name, is_folder, size, reason in _entries(root, folder):
                path = f"{folder}/{name}" if folder else name
                if is_folder and reason is None:
                    yield path, None, None, None
                elif reason is None and size > max_file_bytes:
                    yield None, path, size, "size"
                else:
                    yield None, path, size, reason
        except OSError:
            yield None, folder, None, "unreadable folder" if folder else "unreadable root"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = folders_per_task
        for batch in batches:
            for i in range(batch.num_rows):
                keyed = [batch.column(k).slice(i, 1) for k in keys]
                root = _local(batch.column("root")[i].as_py() or "")
                pending, out = [batch.column("folder")[i].as_py()], []

                def emit():
                    repeated = [c.take(pa.array([0] * len(out))) for c in keyed]
                    return pa.RecordBatch.from_arrays(
                        [*repeated, *[pa.array(c, k) for c, k in zip(zip(*out), arrow)]],
                        names=[*keys, "folder", "path", "size", "reason"])
                # The first folder is always listed, so that every round gets further.
                while pending and (left > 0 or not out and len(pending) == 1):
                    left -= 1
                    for folder, *entry in listed(root, pending.pop()):
                        if folder is not None:
                            pending.append(folder)
                        else:
                            out.append((None, *entry))
                        if len(out) >= ENTRIES:
                            yield emit()
                            out = []
                out += [(folder, None, None, None) for folder in pending]
                if out:
                    yield emit()

    frontier, entries = roots.withColumn("folder", F.lit("")), None
    while True:
        found = stored(frontier.repartition(tasks, "root", "folder").mapInArrow(run, kinds), "listing")
        here = found.filter("path IS NOT NULL").drop("folder")
        entries = here if entries is None else entries.unionByName(here)
        frontier = found.filter("path IS NULL").select(*keys, "folder")
        if frontier.isEmpty():
            return entries


def list_trees(roots: DataFrame, max_file_bytes: int = MAX_SOURCE_BYTES, **listing) -> DataFrame:
    """The files to read of many trees: the columns of ``roots`` (with ``root``), path, size."""
    return list_entries(roots, max_file_bytes, **listing).filter("reason IS NULL").drop("reason")


def _read_or_null(root: str, path: str) -> bytes | None:
    try:
        return _read(_local(root), path)
    except OSError:
        return None


def read_files(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """Adds ``content`` to listed files (root, path, size); null where a file cannot be read, or has a ``reason``.

    The number of tasks follows the listed bytes. Files are dealt out by path and
    small next to a task's share, so shares are even.
    """
    known = F.coalesce(F.col("size"), F.lit(0))
    if partitions is None:
        total = files.agg(F.sum(known)).first()[0] or 0
        partitions = max(_tasks(files, None), -(-total // GROUP_BYTES))
    dealt = files.repartition(partitions, "root", "path")
    names, wanted = files.columns, "reason" in files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, paths = batch.column("root").to_pylist(), batch.column("path").to_pylist()
            reasons = batch.column("reason").to_pylist() if wanted else [None] * len(paths)
            held, first, size = [], 0, 0
            for i, (root, path, reason) in enumerate(zip(roots, paths, reasons)):
                held.append(None if reason is not None else _read_or_null(root, path))
                size += len(held[-1] or b"")
                if size >= BATCH_BYTES or i == len(paths) - 1:
                    part = batch.slice(first, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())],
                                                     names=[*names, "content"])
                    held, first, size = [], i + 1, 0

    return dealt.mapInArrow(run, files.schema.add("content", "binary"))


def _write(root: str, path: str, content: bytes) -> None:
    part = f"{path}.{uuid.uuid4().hex}.part"
    remote = _remote(root)
    if remote is not None:
        system, base = remote
        system.create_dir(os.path.dirname(f"{base}/{path}"), recursive=True)
        with system.open_output_stream(f"{base}/{part}") as stream:
            stream.write(content)
        system.move(f"{base}/{part}", f"{base}/{path}")
        return
    target = os.path.join(root, path)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(os.path.join(root, part), "wb") as stream:
        stream.write(content)
    os.replace(os.path.join(root, part), target)


def export_tree(files: DataFrame, root: str) -> None:
    """Writes (path, content) rows as files below a folder every task can reach.

    A file is written under a name of its own and then put in place, so a task
    that is lost and run again leaves whole files only.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        written = 0
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                _write(_local(root), path, content)
                written += 1
        yield pd.DataFrame({"written": [written]})

    done = files.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(
        run, "written long")
    done.agg(F.sum("written")).collect()
