"""Side-by-side run of registered queries in Spark and DuckDB.

    python tests/oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, (float, decimal.Decimal)):
        return "float"
    if isinstance(v, (dt.date, dt.datetime)):
        return type(v).__name__
    return type(v).__name__


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([cell(r[i]) for i in order] for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def compare(spark, con, fn, sql, sf):
    t = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    cols = df.columns
    if sql is None:
        return len(got), took, None
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(want_cols):
        return len(got), took, f"columns {sorted(cols)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return len(got), took, f"rows {len(got)} != {len(want)}"
    a, b = rows_of(cols, got), rows_of(want_cols, want)
    for x, y in zip(a, b):
        if x != y or [kind(v) for v in x] != [kind(v) for v in y]:
            return len(got), took, f"first difference\n   spark {x}\n   sql   {y}"
    return len(got), took, ""


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from wardline.catalog import load
    from wardline.session import local_session
    spark = local_session(8)
    queries, oracles = load()
    con = connect(args.sf)
    bad = 0
    for name, fn in queries.items():
        if args.names and name not in args.names:
            continue
        try:
            n, took, err = compare(spark, con, fn, oracles.get(name), args.sf)
        except Exception as e:  # noqa: BLE001
            n, took, err = 0, 0.0, f"{type(e).__name__}: {str(e)[:1500]}"
        state = "rows only" if err is None else ("ok" if not err else "WRONG")
        bad += bool(err)
        print(f"{name:32s} {state:9s} {n:8d} {took:7.2f}s {err or ''}", flush=True)
    print(f"{bad} wrong")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
