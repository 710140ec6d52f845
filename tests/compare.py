"""Run registered queries next to their DuckDB SQL and compare values exactly.

    python tests/compare.py [sf folder] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value) + 0.0)
    return str(value)


def normal(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs first."""
    rel = con.sql(sql)
    columns, expected = rel.columns, rel.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    got, want = normal(df.columns, [tuple(r) for r in df.collect()]), normal(columns, expected)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ: {sorted(columns)}\n   {wrong[0][0]}\n   {wrong[0][1]}"
    types = {c: t for c, t in df.dtypes}
    kinds = {c: str(t) for c, t in zip(columns, rel.types)}
    same = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
            "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
    odd = [f"{c}: {types[c]} / {kinds[c]}" for c in sorted(types) if same.get(types[c]) != kinds[c]]
    return f"TYPES {odd}" if odd else None


def main() -> int:
    from feederlake.checks.catalog import CHECKS
    from feederlake.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(CHECKS)
    spark = local_session()
    con = duck(folder)
    failed = 0
    for name in names:
        started = time.time()
        try:
            df = CHECKS[name].run(spark, folder)
            if CHECKS[name].sql is None:
                problem = None if df.count() else "no rows"
            else:
                problem = difference(df, con, CHECKS[name].sql)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} equal")
    return failed


if __name__ == "__main__":
    sys.exit(main())
