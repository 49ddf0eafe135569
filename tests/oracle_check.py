"""Compare registered queries with their oracle SQL: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    return con


def normal(rows, columns) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([columns[i] for i in order] + [row[i] for i in order]) for row in rows)


def compare(spark, con, name: str, sf_dir: str) -> tuple[int, list[str]]:
    """Number of rows and the differing rows, at most five of each side."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    ours = normal(map(tuple, df.collect()), df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    theirs = normal(cur.fetchall(), [d[0] for d in cur.description])
    if ours == theirs:
        return len(ours), []
    a, b = set(ours) - set(theirs), set(theirs) - set(ours)
    diff = [f"rows {len(ours)} / {len(theirs)}"]
    return len(ours), diff + ["+ " + x for x in sorted(a)[:5]] + ["- " + x for x in sorted(b)[:5]]


if __name__ == "__main__":
    import __spark_entry__ as entry
    from roadstats.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, bad = local_session(), connect(sf), 0
    for q in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            n, diff = compare(spark, con, q, sf)
        except Exception as e:  # noqa: BLE001 - report and go on
            n, diff = -1, [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok'} {q} {n} rows {time.time() - start:.1f}s", *diff, sep="\n  ")
    print("failed:", bad)
