"""Runs registered queries next to their SQL and compares whole results.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, folder: str, name: str) -> str | None:
    """None where both engines agree on columns, types and rows."""
    frame = entry.queries()[name](spark, folder)
    rows = [tuple(r) for r in frame.collect()]
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} vs {sorted(columns)}"
    short = {"bigint": "long", "integer": "int", "varchar": "string", "boolean": "bool",
             "timestamp": "ts", "timestamp_ntz": "ts", "int": "int"}
    kinds = {d[0]: str(d[1]).lower() for d in result.description}
    for column, kind in frame.dtypes:
        theirs = kinds[column]
        if short.get(kind, kind) != short.get(theirs, theirs):
            return f"type of {column}: {kind} vs {theirs}"
    mine, other = _sorted(frame.columns, rows), _sorted(columns, result.fetchall())
    if mine != other:
        a, b = set(map(repr, mine)), set(map(repr, other))
        return (f"{len(mine)} vs {len(other)} rows; only here {sorted(a - b)[:3]}; "
                f"only there {sorted(b - a)[:3]}")
    return None if mine else "no rows"


if __name__ == "__main__":
    from srcstrata.session import build_session

    chosen_folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(entry.queries())
    session, connection = build_session(cores=8), connect(chosen_folder)
    session.sparkContext.setLogLevel("ERROR")
    bad = 0
    for query in chosen:
        start = time.time()
        try:
            problem = difference(session, connection, chosen_folder, query)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{query:32s} {time.time() - start:6.1f}s {problem or 'ok'}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")
    sys.exit(bad > 0)
