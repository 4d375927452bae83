"""Run catalogue queries next to their DuckDB check query and compare the rows.

``python tests/compare.py [--sf 0.01] [name prefix ...]``
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return f"{v:.6g}" if v == v else "nan"
    return str(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, name: str, fn, sql: str | None) -> str:
    df = fn(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows-only {len(got)}"
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows_of(names, res.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"FAIL columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {c: t for c, t in df.dtypes}
    theirs = {d[0]: str(d[1]) for d in res.description}
    pair = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    odd = [f"{c}:{kinds[c]}/{theirs[c]}" for c in names if pair.get(kinds[c]) != theirs[c]]
    note = f" types {odd}" if odd else ""
    if got != want:
        left, right = set(got), set(want)
        a, b = list(left - right)[:2], list(right - left)[:2]
        return f"FAIL rows {len(got)} vs {len(want)}; only spark {a}; only sql {b}{note}"
    return f"ok {len(got)}{note}"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{a.sf}"
    con, sqls, bad = views(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if a.names and not any(name.startswith(p) for p in a.names):
            continue
        t = time.time()
        try:
            out = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as exc:  # noqa: BLE001 - report and go on
            out = f"FAIL {type(exc).__name__} {str(exc)[:600]}"
        bad += out.startswith("FAIL")
        print(f"{time.time() - t:6.1f}s {name}: {out}", flush=True)
    print("failed", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
