"""Runs every query beside its SQL in DuckDB and compares rows, as the driver does.

Usage: python tests/oracle_check.py [--sf DIR] [--blocks N] [prefix ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    if isinstance(value, bool):
        return str(int(value))
    return str(value)


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    rows = spark_df.collect()
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    got, want = canonical(spark_df.columns, rows), canonical(names, want)
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0][0]} vs {bad[0][1]} ({sorted(names)})" if bad else None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--blocks", type=int)
    parser.add_argument("prefixes", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from fleetlens.session import build_session

    spark = build_session("oracle-check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="12g", spark__driver__host="127.0.0.1")
    spark.sparkContext.setLogLevel("ERROR")
    if args.blocks:
        spark.conf.set("spark.fleetlens.blockRows", str(args.blocks))
    con, oracle, failed = connect(args.sf), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if args.prefixes and not any(name.startswith(p) for p in args.prefixes):
            continue
        begin = time.time()
        try:
            df = query(spark, args.sf)
            if name in oracle:
                problem = compare(df, con, oracle[name])
                status = "ok" if problem is None else f"DIFF {problem}"
            else:
                status = f"rows {len(df.collect())}"
        except Exception as e:  # noqa: BLE001
            status = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        failed += status.startswith(("DIFF", "ERROR"))
        print(f"{name:34s} {time.time() - begin:6.2f}s {status}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
