"""Run registered queries in Spark and their oracle SQL in DuckDB, compare.

    python tests/oracle_check.py [--sf /root/testdata/sf0.01] [name ...]

Compares column names, row counts and the sorted multiset of rows (values
normalised to text). Prints one line per query and exits non-zero on any
mismatch.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v)


def rows_of(records, cols):
    return sorted(tuple(_norm(r[c]) for c in cols) for r in records)


def duck(sf: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def compare(spark, con, name, fn, sql, sf):
    t0 = time.time()
    sdf = fn(spark, sf)
    s_cols = sdf.columns
    s_rows = [r.asDict() for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = [dict(zip(d_cols, r)) for r in rel.fetchall()]
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ spark={s_cols} duck={d_cols}", t1 - t0
    cols = sorted(s_cols)
    a, b = rows_of(s_rows, cols), rows_of(d_rows, cols)
    if len(a) != len(b):
        return False, f"rows spark={len(a)} duck={len(b)}", t1 - t0
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ ({len(a)} rows) e.g. {diff}", t1 - t0
    return True, f"{len(a)} rows", t1 - t0


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args(argv)
    import __spark_entry__ as entry
    from schemaloom.session import build_session
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck(args.sf)
    bad = 0
    for name in args.names or list(qs):
        if name not in sqls:
            print(f"{name:22s} SKIP (no oracle)")
            continue
        try:
            ok, msg, sec = compare(spark, con, name, qs[name], sqls[name], args.sf)
        except Exception as e:  # noqa: BLE001
            ok, msg, sec = False, f"ERROR {type(e).__name__}: {str(e)[:300]}", 0.0
        bad += not ok
        print(f"{name:22s} {'OK ' if ok else 'BAD'} {sec:6.1f}s {msg}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
