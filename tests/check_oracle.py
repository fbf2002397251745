"""Compare every query with its SQL counterpart in DuckDB.

Usage: python tests/check_oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _rows(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(float(r[i]) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


def compare(spark, con, sf: str, name: str) -> str | None:
    """None when equal, else what differs."""
    df = entry.queries()[name](spark, sf)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    wanted = _rows(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {df.columns} against {columns}"
    if got != wanted:
        only_got, only_wanted = sorted(set(got) - set(wanted)), sorted(set(wanted) - set(got))
        return f"{len(got)} against {len(wanted)} rows; {only_got[:3]} / {only_wanted[:3]}"
    return None


def main() -> int:
    from engram.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name in sys.argv[2:] or entry.oracle_sql():
        start = time.time()
        try:
            problem = compare(spark, con, sf, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:500]}"
        bad += problem is not None
        print(f"{name:28s} {'ok' if problem is None else problem}  {time.time() - start:.2f}s", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
