"""Runs registered queries next to their SQL and compares the rows.

    python -m tests.oracle [folder] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime

import duckdb

from pastward.catalog import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, datetime) and value.time() == datetime.min.time():
        return value
    if isinstance(value, date) and not isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def ordered(rows):
    return sorted((tuple(normal(v) for v in row) for row in rows), key=lambda row: [(v is None, str(type(v)), v if v is not None else 0) for v in row])


def kind(value) -> str:
    return type(value).__name__


def difference(spark, con, name: str, folder: str) -> str | None:
    """None when both sides agree in columns, row count, value types and values."""
    left = QUERIES[name](spark, folder)
    right = con.execute(ORACLES[name])
    right_names = [d[0] for d in right.description]
    if sorted(left.columns) != sorted(right_names):
        return f"columns {sorted(left.columns)} != {sorted(right_names)}"
    names = sorted(left.columns)
    mine = ordered([row[c] for c in names] for row in left.collect())
    theirs = ordered([row[right_names.index(c)] for c in names] for row in right.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)} rows"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b or [kind(x) for x in a] != [kind(x) for x in b]]
    if wrong:
        return f"{len(wrong)} of {len(mine)} rows differ, first: {names} {wrong[0]}"
    return None


def main() -> int:
    from pastward.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = local_session()
    con = connect(folder)
    bad = 0
    for name in QUERIES:
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                problem = difference(spark, con, name, folder)
                rows = ""
            else:
                rows = f" {len(QUERIES[name](spark, folder).collect())} rows, no SQL"
                problem = None
        except Exception as exc:  # report and go on with the next query
            problem, rows = f"{type(exc).__name__}: {str(exc)[:1500]}", ""
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - start:.2f}s{rows} {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
