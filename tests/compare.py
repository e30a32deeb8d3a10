"""Run registered queries beside their DuckDB statements and compare."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb


def connection(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{root}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (int, str)):
        return value
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, con, root, name, queries, oracles):
    """(problem or None, row count, spark seconds, duckdb seconds)."""
    started = time.time()
    df = queries[name](spark, root)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    n = sum(got.values())
    if name not in oracles:
        return None, n, spent, 0.0
    started = time.time()
    cursor = con.execute(oracles[name])
    want_columns, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    duck = time.time() - started
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}", n, spent, duck
    if got != want:
        extra, missing = got - want, want - got
        return (
            f"{sum(extra.values())} extra {list(extra)[:2]}, {sum(missing.values())} missing {list(missing)[:2]}",
            n, spent, duck,
        )
    if n == 0:
        return "no rows on either side", n, spent, duck
    return None, n, spent, duck


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from lakestate.session import local_session

    root = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    con = connection(root)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    names = [n for n in queries if not wanted or any(n == w or n.startswith(w + "*") or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
    for name in names:
        try:
            problem, n, spent, duck = check(spark, con, root, name, queries, oracles)
        except Exception as error:
            problem, n, spent, duck = f"{type(error).__name__}: {str(error)[:700]}", -1, 0.0, 0.0
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        sql = "sql" if name in oracles else "---"
        print(f"{mark} {sql} {name:34s} rows={n:<8d} spark={spent:6.2f}s duck={duck:5.2f}s {problem or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
