"""Run registered Spark queries and their DuckDB oracles side by side and compare results.

usage: python tools/oracle_check.py [--sf DIR] [key ...]
Prints one line per key: OK / MISMATCH / ERROR with row counts.
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import os
import sys
import time
import traceback
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from roadlens.adapters import BASE_TABLES  # noqa: E402
from roadlens.plans.registry import load_all  # noqa: E402
from roadlens.session import build_session, clear_scratch  # noqa: E402


def norm(v):
    if v is None:
        return None
    try:
        import pandas as pd
        if v is pd.NA or v is pd.NaT:
            return None
    except Exception:
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 5)
    if hasattr(v, "item") and not isinstance(v, (list, tuple)):
        try:
            return norm(v.item())
        except Exception:
            pass
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(norm(x) for x in v.tolist())
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = Counter()
    for rec in pdf[cols].itertuples(index=False, name=None):
        out[tuple(norm(x) for x in rec)] += 1
    return cols, out


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    reg = load_all()
    keys = args.keys or sorted(reg)
    spark = build_session("oracle-check")
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.sf}/{t}.parquet')")
    n_ok = 0
    for k in keys:
        e = reg[k]
        t0 = time.time()
        try:
            sp = e.build(spark, args.sf).toPandas()
        except Exception:
            print(f"ERROR-SPARK {k}\n{traceback.format_exc(limit=3)}")
            continue
        ts = time.time() - t0
        if not e.sql:
            print(f"ROWS   {k}: spark rows={len(sp)} ({ts:.1f}s)")
            continue
        try:
            dd = con.sql(e.sql).df()
        except Exception as ex:
            print(f"ERROR-DUCK {k}: {ex}")
            continue
        sc, sr = rows_of(sp)
        dc, dr = rows_of(dd)
        if sc != dc:
            print(f"MISMATCH-COLS {k}: spark={sc} duck={dc}")
            continue
        if sr == dr:
            n_ok += 1
            print(f"OK     {k}: rows={len(sp)} ({ts:.1f}s)")
        else:
            only_s = list((sr - dr).items())[:3]
            only_d = list((dr - sr).items())[:3]
            print(f"MISMATCH {k}: spark={len(sp)} duck={len(dd)}\n  spark-only={only_s}\n  duck-only={only_d}")
    print(f"{n_ok}/{len(keys)} matched")
    clear_scratch(spark)


if __name__ == "__main__":
    main()
