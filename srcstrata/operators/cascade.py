"""Deletes that follow the foreign keys of the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcstrata.operators.relational import null_safe_join
from srcstrata.schemas import TABLES, ForeignKey, Table
from srcstrata.session import stored


def cascade_delete(tables: dict[str, DataFrame], root: str, ids: DataFrame
                   ) -> tuple[dict[str, DataFrame], DataFrame]:
    """Deletes rows of ``root`` by id: (all tables afterwards, ids not found).

    Tables are visited parents first. Through a CASCADE key a row goes with its
    parent; through a SET NULL key only the named columns are emptied. The keys
    removed from a parent are stored, so that its children neither find them
    again nor have to guess their size; the tables themselves stay lazy.
    """
    ids = ids.select("id").distinct()
    unknown = ids.join(tables[root].select("id"), "id", "left_anti")
    removed: dict[str, DataFrame] = {root: stored(tables[root].join(ids, "id", "left_semi").select(
        *_columns_named_by_children(root)), f"removed-{root}")}
    out = {root: tables[root].join(ids, "id", "left_anti")}
    for name, table in TABLES.items():
        if name == root or name not in tables:
            continue
        kept, gone = tables[name], []
        for fk in _followed(table, root):
            if fk.on_delete == "cascade" and fk.parent in removed:
                dead = _parent_keys(removed[fk.parent], fk)
                gone.append(null_safe_join(tables[name], dead, fk.columns, "left_semi"))
                kept = null_safe_join(kept, dead, fk.columns, "left_anti")
        named = _columns_named_by_children(name)
        if gone and named and any(_refers_to(child, name, root) for child in tables):
            removed[name] = stored(reduce(DataFrame.unionByName, [g.select(*named) for g in gone]
                                          ).distinct(), f"removed-{name}")
        for fk in _followed(table, root):
            if fk.on_delete == "set_null" and fk.parent in removed:
                kept = _empty_columns(kept, _parent_keys(removed[fk.parent], fk), fk)
        out[name] = kept.select(*tables[name].columns)
    return _carry_keys(out, removed, root), unknown


def _columns_named_by_children(parent: str) -> list[str]:
    return sorted({column for table in TABLES.values() for fk in table.foreign_keys
                   if fk.parent == parent for column in fk.parent_columns})


def _refers_to(child: str, parent: str, root: str) -> bool:
    return any(fk.parent == parent and fk.on_delete != "no_action"
               for fk in _followed(TABLES[child], root))


def _followed(table: Table, root: str) -> list[ForeignKey]:
    """The foreign keys to look at when rows of ``root`` go.

    When whole repositories go, a table that names its repository loses the
    same rows through that key as through longer keys that hold the repository.
    """
    whole = ForeignKey(("repository_id",), "repositories", ("id",))
    if root != "repositories" or whole not in table.foreign_keys:
        return list(table.foreign_keys)
    return [whole, *(fk for fk in table.foreign_keys if "repository_id" not in fk.columns)]


def _parent_keys(removed: DataFrame, fk) -> DataFrame:
    return removed.select(*[F.col(p).alias(c) for c, p in zip(fk.columns, fk.parent_columns)])


def _empty_columns(rows: DataFrame, dead: DataFrame, fk) -> DataFrame:
    marked = rows.join(dead.distinct().withColumn("__dead", F.lit(True)), list(fk.columns), "left")
    return marked.withColumns({
        c: F.when(F.col("__dead"), F.lit(None)).otherwise(F.col(c)) for c in fk.null_columns
    }).drop("__dead")


def _carry_keys(out: dict[str, DataFrame], removed: dict[str, DataFrame], root: str
                ) -> dict[str, DataFrame]:
    """Classes, methods and dependencies follow their file's emptied branch.

    They name the branch next to the file's key, so it is emptied along with the
    file's; the key stays, and with it the file they belong to.
    """
    if root != "branches":
        return out
    branch = next(fk for fk in TABLES["source_files"].foreign_keys if fk.parent == "branches")
    dead = _parent_keys(removed["branches"], branch)
    for name in ("classes", "methods", "dependencies"):
        if name in out:
            out[name] = _empty_columns(out[name], dead, branch).select(*out[name].columns)
    return out


def delete_repositories(tables: dict[str, DataFrame], ids: DataFrame):
    return cascade_delete(tables, "repositories", ids)


def delete_branches(tables: dict[str, DataFrame], ids: DataFrame):
    return cascade_delete(tables, "branches", ids)
