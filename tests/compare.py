"""Run registered queries and their SQL side by side and compare the values.

`python tests/compare.py [sf_dir] [name ...]` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, decimal.Decimal):
        return float(value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, fn, sql):
    """None if equal, else what differs."""
    df = fn(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    if sql is None:
        return None if ours else "no rows"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = rows_of(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    if not ours:
        return "no rows"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{sorted(names)}: {a} != {b}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    sqls, failed = oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok':5}{name} {time.time() - start:.1f}s {(problem or '')[:700]}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
