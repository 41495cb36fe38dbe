"""Compares a query with its SQL on the test tables; also a command: python tests/compare.py SF NAME..."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
from collections import Counter
from decimal import Decimal

import duckdb

ROOT = os.environ.get("TESTDATA_DIR", "/root/testdata")


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'").fetchall()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{path}')").fetchall()
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = connection(sf_dir)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())


def rows_of_spark(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(map(plain, r)) for r in df.select(*names).collect())


def differences(df, sql: str, sf_dir: str) -> str:
    (a_names, a), (b_names, b) = rows_of_spark(df), rows_of_sql(sql, sf_dir)
    if a_names != b_names:
        return f"columns {a_names} against {b_names}"
    if a != b:
        return f"{sum(a.values())} rows against {sum(b.values())}; only Spark: {list((a - b).items())[:4]}; only SQL: {list((b - a).items())[:4]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import time

    import __spark_entry__ as e

    from eventloom.session import get_session

    sf, names = f"{ROOT}/{sys.argv[1]}", sys.argv[2:]
    spark, qs, os_ = get_session(), e.queries(), e.oracle_sql()
    for n in names or [x for x in qs if x in os_]:
        began = time.time()
        try:
            said = differences(qs[n](spark, sf), os_[n], sf) if n in os_ else f"{qs[n](spark, sf).count()} rows, no SQL"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:600]}"
        print(f"{n}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
