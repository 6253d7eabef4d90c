"""Run every query in Spark and its SQL in DuckDB, and compare rows as multisets: `python -m checks.compare SF_DIR [name …]`."""

from __future__ import annotations

import shutil
import sys
import tempfile
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import all_sql
from checks.queries import all_queries
from tallyhouse.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def difference(columns: list[str], ours: list[tuple], oracle_columns: list[str], theirs: list[tuple]) -> str | None:
    """What differs, or None; columns are compared by name."""
    if sorted(columns) != sorted(oracle_columns):
        return f"columns {sorted(columns)} against {sorted(oracle_columns)}"
    order, other = (sorted(range(len(c)), key=c.__getitem__) for c in (columns, oracle_columns))
    left = Counter(tuple(r[i] for i in order) for r in ours)
    right = Counter(tuple(r[i] for i in other) for r in theirs)
    if left != right:
        return f"{len(ours)} against {len(theirs)} rows; only here {list((left - right))[:3]}; only there {list((right - left))[:3]}"
    return None


def run(spark: SparkSession, sf_dir: str, names: list[str]) -> int:
    con, sql, failed = oracle_connection(sf_dir), all_sql(), 0
    for name, query in all_queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            df = query(spark, sf_dir)
            ours = [tuple(r) for r in df.collect()]
            took = time.time() - began
            found = con.sql(sql[name])
            problem = difference(df.columns, ours, list(found.columns), found.fetchall())
        except Exception as error:  # noqa: BLE001 - report and go on
            took, ours, problem = time.time() - began, [], f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {len(ours)} rows {took:.2f}s {problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    scratch = tempfile.mkdtemp(prefix="compare-")
    session = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__checkpoint__dir=scratch
    )
    session.sparkContext.setLogLevel("ERROR")
    failures = run(session, sys.argv[1], sys.argv[2:])
    session.stop()
    shutil.rmtree(scratch, ignore_errors=True)
    sys.exit(1 if failures else 0)
