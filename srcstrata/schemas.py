"""The fourteen catalogue tables, their keys and their rules, as data.

Leaf tables (files, classes, methods, dependencies) have natural keys and, in
place of a sequence, a ``file_key``: the hash of the file's natural key when it was
scanned, which stays when a deleted branch is emptied from that key. The others
keep a surrogate ``id``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --- fixed values: enumerations -------------------------------------------
SCAN_STATUS = ["pending", "running", "completed", "failed", "cancelled"]
TRIGGER_TYPE = ["manual", "scheduled", "webhook"]
CHANGE_TYPE = ["added", "modified", "deleted", "renamed", "copied"]
ARTIFACT_TYPE = ["llm_context", "summary", "diff_patch", "metrics", "risk_report"]
ARTIFACT_FORMAT = ["json", "markdown", "patch", "text"]

_TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "str": T.StringType(),
    "bool": T.BooleanType(), "ts": T.TimestampType(), "date": T.DateType(),
    "dec": T.DecimalType(5, 2),
}


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "cascade"          # cascade | set_null | no_action
    null_columns: tuple[str, ...] = ()  # what set_null empties


@dataclass(frozen=True)
class Unique:
    columns: tuple[str, ...]
    nulls_distinct: bool = True
    where: str | None = None            # partial unique key


@dataclass(frozen=True)
class Table:
    # "name type" or "name type(limit)"; a trailing * marks NOT NULL
    columns: tuple[str, ...]
    key: tuple[str, ...]
    unique: tuple[Unique, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)     # rule -> SQL predicate
    domains: dict[str, list[str]] = field(default_factory=dict)
    foreign_keys: tuple[ForeignKey, ...] = ()

    def _parsed(self):
        for spec in self.columns:
            name, kind = spec.rstrip("*").split()
            base, _, limit = kind.partition("(")
            yield name, base, int(limit.rstrip(")")) if limit else None, spec.endswith("*")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, _TYPES[b], not required)
                             for n, b, _, required in self._parsed()])

    @property
    def names(self) -> list[str]:
        return [n for n, _, _, _ in self._parsed()]

    @property
    def required(self) -> list[str]:
        return [n for n, _, _, required in self._parsed() if required]

    @property
    def text_limits(self) -> dict[str, int]:
        return {n: limit for n, _, limit, _ in self._parsed() if limit}

    @property
    def all_checks(self) -> dict[str, str]:
        """CHECK predicates, the enumerations included."""
        listed = {c: f"{c} IN ({', '.join(repr(v) for v in values)})"
                  for c, values in self.domains.items()}
        return {**{f"{c}_domain": p for c, p in listed.items()}, **self.checks}


def _not_blank(column: str) -> dict[str, str]:
    return {f"{column}_not_blank": f"length(trim({column})) > 0"}


def _not_negative(*columns: str) -> dict[str, str]:
    return {f"{c}_not_negative": f"{c} >= 0" for c in columns}


_REPOSITORY = ForeignKey(("repository_id",), "repositories", ("id",))
_BRANCH = ForeignKey(("repository_id", "branch_id"), "branches", ("repository_id", "id"))
_BRANCH_OR_NULL = ForeignKey(_BRANCH.columns, "branches", _BRANCH.parent_columns,
                             "set_null", ("branch_id",))
_SCAN = ForeignKey(("scan_run_id",), "scan_runs", ("id",))
_SCAN_OR_NULL = ForeignKey(("scan_run_id",), "scan_runs", ("id",), "set_null", ("scan_run_id",))

FILE_KEY = ("repository_id", "branch_id", "path")

# --- fixed values: table definitions ---------------------------------------
# Ordered so that every parent comes before its children.
TABLES: dict[str, Table] = {
    "repositories": Table(
        ("id long*", "name str(255)*", "url str*", "created_at ts*", "updated_at ts*"),
        key=("id",), unique=(Unique(("url",)),)),
    "branches": Table(
        ("id long*", "repository_id long*", "name str(255)*", "is_default bool*",
         "last_seen_commit_sha str(64)", "last_scanned_commit_sha str(64)",
         "created_at ts*", "updated_at ts*"),
        key=("id",),
        unique=(Unique(("repository_id", "name")), Unique(("repository_id", "id")),
                Unique(("repository_id",), where="is_default")),
        foreign_keys=(_REPOSITORY,)),
    "commits": Table(
        ("id long*", "repository_id long*", "sha str(64)*", "author_name str(255)",
         "author_email str(320)", "message str", "committed_at ts", "discovered_at ts*"),
        key=("id",),
        unique=(Unique(("repository_id", "sha")), Unique(("repository_id", "id"))),
        checks=_not_blank("sha"), foreign_keys=(_REPOSITORY,)),
    "branch_commits": Table(
        ("id long*", "repository_id long*", "branch_id long*", "commit_id long*",
         "first_seen_at ts*"),
        key=("id",), unique=(Unique(("branch_id", "commit_id")),),
        foreign_keys=(_REPOSITORY, _BRANCH,
                      ForeignKey(("repository_id", "commit_id"), "commits",
                                 ("repository_id", "id")))),
    "scan_runs": Table(
        ("id long*", "repository_id long*", "branch_id long*", "base_commit_sha str(64)",
         "head_commit_sha str(64)*", "status str(50)*", "trigger_type str(50)*",
         "started_at ts*", "completed_at ts", "error_message str"),
        key=("id",),
        checks={**_not_blank("head_commit_sha"),
                "completed_after_started": "completed_at IS NULL OR completed_at >= started_at"},
        domains={"status": SCAN_STATUS, "trigger_type": TRIGGER_TYPE},
        foreign_keys=(_REPOSITORY, _BRANCH,
                      ForeignKey(("repository_id", "base_commit_sha"), "commits",
                                 ("repository_id", "sha"), "no_action"),
                      ForeignKey(("repository_id", "head_commit_sha"), "commits",
                                 ("repository_id", "sha"), "no_action"))),
    "file_changes": Table(
        ("scan_run_id long*", "path str*", "old_path str", "change_type str(50)*",
         "additions int*", "deletions int*", "patch_uri str"),
        key=("scan_run_id", "path"), unique=(Unique(("scan_run_id", "path")),),
        checks={**_not_negative("additions", "deletions"), **_not_blank("path")},
        domains={"change_type": CHANGE_TYPE}, foreign_keys=(_SCAN,)),
    "analysis_artifacts": Table(
        ("id long*", "repository_id long*", "branch_id long", "scan_run_id long",
         "artifact_type str(50)*", "format str(50)*", "uri str*", "content_hash str(128)",
         "generated_at ts*"),
        key=("id",), unique=(Unique(("uri",)),), checks=_not_blank("uri"),
        domains={"artifact_type": ARTIFACT_TYPE, "format": ARTIFACT_FORMAT},
        foreign_keys=(_REPOSITORY, _BRANCH_OR_NULL, _SCAN)),
    "source_files": Table(
        ("repository_id long*", "branch_id long", "scan_run_id long", "path str*",
         "language str(100)", "loc int*", "file_key str(64)*"),
        key=FILE_KEY, unique=(Unique(FILE_KEY, nulls_distinct=False), Unique(("file_key",))),
        checks={**_not_negative("loc"), **_not_blank("path")},
        foreign_keys=(_REPOSITORY, _BRANCH_OR_NULL, _SCAN_OR_NULL)),
    "classes": Table(
        ("repository_id long*", "branch_id long", "path str*", "name str(255)*", "loc int*",
         "method_count int*", "file_key str(64)*"),
        key=(*FILE_KEY, "name"), unique=(Unique(("file_key", "name")),),
        checks=_not_negative("loc", "method_count"),
        foreign_keys=(ForeignKey(("file_key",), "source_files", ("file_key",)),)),
    "methods": Table(
        ("repository_id long*", "branch_id long", "path str*", "class_name str*",
         "name str(255)*", "loc int*", "complexity int*", "file_key str(64)*"),
        key=(*FILE_KEY, "class_name", "name"),
        unique=(Unique(("file_key", "class_name", "name")),),
        checks=_not_negative("loc", "complexity"),
        foreign_keys=(ForeignKey(("file_key", "class_name"), "classes", ("file_key", "name")),)),
    "dependencies": Table(
        ("repository_id long*", "branch_id long", "source_path str*", "source_class str*",
         "target_class str*", "target_files long*", "dependency_type str(100)*", "file_key str(64)*"),
        key=("repository_id", "branch_id", "source_path", "source_class", "target_class",
             "dependency_type"),
        unique=(Unique(("file_key", "source_class", "target_class", "dependency_type")),),
        # Only other files are targets, so a row without any would be a class that names itself.
        checks={"target_files_positive": "target_files > 0"},
        foreign_keys=(
            ForeignKey(("file_key", "source_class"), "classes", ("file_key", "name")),
            # A name may have several defining files, so it does not go with one of them.
            ForeignKey(("repository_id", "branch_id", "target_class"), "classes",
                       ("repository_id", "branch_id", "name"), "no_action"))),
    "repository_metrics": Table(
        ("repository_id long*", "branch_id long", "scan_run_id long", "date date*",
         "file_count int*", "class_count int*", "method_count int*", "dependency_count int*"),
        key=("repository_id", "branch_id", "date"),
        unique=(Unique(("repository_id", "branch_id", "date"), nulls_distinct=False),),
        checks=_not_negative("file_count", "class_count", "method_count", "dependency_count"),
        foreign_keys=(_REPOSITORY, _BRANCH_OR_NULL, _SCAN_OR_NULL)),
    "risk_scores": Table(
        ("id long*", "repository_id long*", "branch_id long", "scan_run_id long",
         "module_name str(255)*", "score dec*", "reason str", "generated_at ts*"),
        key=("id",), checks={"score_range": "score >= 0 AND score <= 100"},
        foreign_keys=(_REPOSITORY, _BRANCH_OR_NULL, _SCAN_OR_NULL)),
    "technical_debt": Table(
        ("id long*", "repository_id long*", "branch_id long", "scan_run_id long",
         "module_name str(255)*", "type str(100)*", "severity str(50)*", "description str*",
         "created_at ts*"),
        key=("id",), foreign_keys=(_REPOSITORY, _BRANCH_OR_NULL, _SCAN_OR_NULL)),
}
