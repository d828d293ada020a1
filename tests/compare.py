"""Run registered jobs on Spark and their SQL on DuckDB, and compare the rows.

Usage: python tests/compare.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lisura.plans import jobs  # noqa: E402
from lisura.plans.views import TABLES  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x):.6g}" if abs(float(x)) < 1e15 else str(x)
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, fn, sql):
    """(ok, message)"""
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return True, f"{len(got)} rows, no SQL"
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_names):
        return False, f"columns {sorted(df.columns)} != {sorted(want_names)}"
    a, b = rows_of(df.columns, got), rows_of(want_names, want)
    if a == b:
        return True, f"{len(a)} rows"
    sa, sb = set(a), set(b)
    return False, f"{len(a)} != {len(b)} rows; only spark {sorted(sa - sb)[:2]}; only sql {sorted(sb - sa)[:2]}"


def main(argv):
    from lisura.session import local_session

    folder = argv[1] if len(argv) > 1 else "/root/testdata/sf0.001"
    prefixes = tuple(argv[2:])
    spark = local_session()
    con = connect(folder)
    sqls = jobs.oracle_sql()
    bad = 0
    for name, fn in jobs.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            ok, message = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as exc:  # report and go on
            ok, message = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {message}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
