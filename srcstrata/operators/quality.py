"""The schema's constraints as set-level checks.

Every check returns ``table_name, rule, key, detail``. Row rules of a table are
evaluated together in one pass; key and reference rules are aggregated on their
key before anything is shuffled or joined, so a hot key is one row by then.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcstrata.operators.relational import null_safe_join
from srcstrata.schemas import TABLES, ForeignKey, Unique

COLUMNS = ["table_name", "rule", "key", "detail"]


def key_text(columns) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _row_rules(name: str, df: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame | None:
    """One pass over a table: rule -> (is violated, detail).

    The plain filter comes first: the array of hits is built for rows that break a rule only.
    """
    if not rules:
        return None
    df = df.filter(reduce(lambda x, y: x | y, [bad for bad, _ in rules.values()]))
    hits = F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), detail.alias("detail")))
                     for rule, (bad, detail) in rules.items()])
    return df.select(
        F.lit(name).alias("table_name"), key_text(TABLES[name].key).alias("key"),
        F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("hit"),
    ).select("table_name", "hit.rule", "key", "hit.detail")


def check_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """CHECK rules; a rule that is null passes."""
    parts = [_row_rules(name, tables[name], {
        rule: (~F.coalesce(F.expr(predicate), F.lit(True)), F.lit(predicate))
        for rule, predicate in table.all_checks.items()
    }) for name, table in TABLES.items() if name in tables]
    return _union([p for p in parts if p is not None])


def not_null_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """NOT NULL markers."""
    return _union([_row_rules(name, tables[name], {
        f"{c}_required": (F.col(c).isNull(), F.lit("null")) for c in table.required
    }) for name, table in TABLES.items() if name in tables])


def text_length_check(tables: dict[str, DataFrame],
                      limits: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """Texts longer than their column allows; the detail is the length found."""
    limits = limits or {}
    parts = [_row_rules(name, tables[name], {
        f"{c}_length": (F.coalesce(F.char_length(c) > limit, F.lit(False)),
                        F.char_length(c).cast("string"))
        for c, limit in {**table.text_limits, **limits.get(name, {})}.items()
    }) for name, table in TABLES.items() if name in tables]
    return _union([p for p in parts if p is not None])


def domain_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Values outside an enumeration, counted by value."""
    parts = []
    for name, table in TABLES.items():
        for column, values in table.domains.items():
            if name in tables:
                # The filter is on the grouping key, so counts are partial per task.
                parts.append(
                    tables[name].filter(~F.col(column).isin(values)).groupBy(column)
                    .agg(F.count("*").alias("n")).select(
                        F.lit(name).alias("table_name"), F.lit(f"{column}_domain").alias("rule"),
                        F.col(column).alias("key"), F.col("n").cast("string").alias("detail")))
    return _union(parts)


def _unique_rule(unique: Unique) -> str:
    name = f"unique_{'_'.join(unique.columns)}"
    return f"{name}_where_{unique.where}" if unique.where else name


def unique_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Keys held by more than one row; plain keys ignore rows with a null part."""
    parts = []
    for name, table in TABLES.items():
        for unique in table.unique:
            if name in tables:
                parts.append(_duplicates(name, tables[name], unique))
    return _union(parts)


def _duplicates(name: str, df: DataFrame, unique: Unique) -> DataFrame:
    if unique.where:
        df = df.filter(unique.where)
    if unique.nulls_distinct:
        df = df.dropna(subset=list(unique.columns))
    return (df.groupBy(*unique.columns).agg(F.count("*").alias("n")).filter("n > 1")
            .select(F.lit(name).alias("table_name"), F.lit(_unique_rule(unique)).alias("rule"),
                    key_text(unique.columns).alias("key"),
                    F.col("n").cast("string").alias("detail")))


def one_default_branch(branches: DataFrame) -> DataFrame:
    """Repositories with more than one default branch."""
    return _duplicates("branches", branches, Unique(("repository_id",), where="is_default"))


def _reference_rule(fk: ForeignKey) -> str:
    return f"{'_'.join(fk.columns)}_in_{fk.parent}"


def foreign_key_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Referenced keys that no parent row has, with the number of rows naming them.

    A null where the parent's column is NOT NULL is no reference and passes. Where
    the parent's column may be null, as a file's branch, null is part of the key.

    Every table is read once: a row gives an entry for each key it holds and each
    key it names. All entries are aggregated together by (key, values), counts per
    naming column before the one shuffle, so a key that most rows name is a row
    per task by then.
    """
    named_by: dict[tuple[str, tuple[str, ...]], list[tuple[str, ForeignKey]]] = {}
    for name, table in TABLES.items():
        for fk in table.foreign_keys:
            if name in tables and fk.parent in tables:
                named_by.setdefault((fk.parent, fk.parent_columns), []).append((name, fk))
    if not named_by:
        raise ValueError("no table with its parent")
    keys = list(named_by)
    values = [f"k{i}" for i in range(max(len(columns) for _, columns in keys))]

    def entry(key: int, slot: int, columns) -> Column:
        padded = [F.col(c).cast("string") for c in columns] + [F.lit(None).cast("string")] * (len(values) - len(columns))
        return F.struct(F.lit(key).alias("key"), F.lit(slot).alias("slot"), *[c.alias(v) for c, v in zip(padded, values)])

    parts = []
    for name, rows in tables.items():
        entries = [entry(i, -1, columns) for i, (parent, columns) in enumerate(keys) if parent == name]
        for i, key in enumerate(keys):
            for slot, (child, fk) in enumerate(named_by[key]):
                if child == name:
                    always = [c for c, p in zip(fk.columns, fk.parent_columns) if p in TABLES[fk.parent].required]
                    named = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in always], F.lit(True))
                    entries.append(F.when(named, entry(i, slot, fk.columns)))
        if entries:
            parts.append(rows.select(F.explode(F.array(*entries)).alias("e")).filter("e IS NOT NULL").select("e.*"))
    slots = range(max(map(len, named_by.values())))
    counted = _union(parts).groupBy("key", *values).agg(
        F.max(F.col("slot") < 0).alias("held"), *[F.sum((F.col("slot") == s).cast("long")).alias(f"n{s}") for s in slots])
    rule = {(i, s): (child, _reference_rule(fk), key_text(values[:len(fk.columns)]))
            for i, key in enumerate(keys) for s, (child, fk) in enumerate(named_by[key])}
    hits = F.array(*[F.when((F.col("key") == i) & (F.col(f"n{s}") > 0), F.struct(
        F.lit(child).alias("table_name"), F.lit(said).alias("rule"), text.alias("key"),
        F.col(f"n{s}").cast("string").alias("detail"))) for (i, s), (child, said, text) in rule.items()])
    return counted.filter("NOT held").select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("hit")).select("hit.*")


def orphan_rows(child: DataFrame, parent: DataFrame, columns, parent_columns) -> DataFrame:
    """Child rows whose reference no parent row has; a null part passes.

    The missing keys are found on the aggregated child, then only those rows
    are picked, so a hot parent key is never shuffled with all its children.
    """
    fk = ForeignKey(tuple(columns), "", tuple(parent_columns))
    keys = parent.select(*[F.col(p).alias(c) for c, p in zip(fk.columns, fk.parent_columns)])
    missing = (child.dropna(subset=list(columns)).select(*columns).distinct()
               .join(keys, list(columns), "left_anti"))
    return null_safe_join(child, missing, columns, "left_semi")


def all_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Every rule of the catalogue in one report."""
    return _union([check_constraints(tables), not_null_violations(tables),
                   text_length_check(tables), unique_violations(tables),
                   foreign_key_violations(tables)])
