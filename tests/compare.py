"""Runs a registered query in Spark and its oracle in DuckDB and compares them row by row."""
from __future__ import annotations

import math
import sys
import time
from importlib import import_module

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, int)):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
        return round(float(v), 6) + 0.0
    return str(v)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(columns), sorted(out, key=lambda t: tuple((x is None, isinstance(x, str), x if x is not None else 0) for x in t))


def close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return abs(a - b) <= 2e-6 * max(1.0, abs(a))
    return a == b


def compare(spark, name, query, sql, sf_dir):
    """(ok, message, seconds in Spark, seconds in DuckDB)."""
    t0 = time.time()
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return True, f"{len(got[1])} rows, no oracle", t1 - t0, 0.0
    con = duck(sf_dir)
    rel = con.execute(sql)
    want = rows([d[0] for d in rel.description], rel.fetchall())
    t2 = time.time()
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}", t1 - t0, t2 - t1
    if len(got[1]) != len(want[1]):
        return False, f"rows {len(got[1])} != {len(want[1])}: {got[1][:2]} / {want[1][:2]}", t1 - t0, t2 - t1
    exact = sum(a == b for a, b in zip(got[1], want[1]))
    bad = [(a, b) for a, b in zip(got[1], want[1]) if not all(close(x, y) for x, y in zip(a, b))]
    if bad:
        return False, f"{len(bad)} of {len(want[1])} rows differ: {got[0]} {bad[:2]}", t1 - t0, t2 - t1
    note = "" if exact == len(want[1]) else f" ({len(want[1]) - exact} differ in the last digit)"
    return True, f"{len(want[1])} rows{note}", t1 - t0, t2 - t1


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from quotelab.session import local_session

    sf = sys.argv[1]
    wanted = []
    for a in sys.argv[2:]:  # a query, or @module for all of a catalogue module
        wanted += list(import_module(f"catalog.{a[1:]}").QUERIES) if a.startswith("@") else [a]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    q, o = queries(), oracle_sql()
    failed = []
    for n in wanted or q:
        try:
            ok, msg, ts, td = compare(spark, n, q[n], o.get(n), sf)
        except Exception as e:  # report and go on with the next query
            ok, msg, ts, td = False, f"{type(e).__name__}: {str(e)[:1500]}", 0, 0
        if not ok:
            failed.append(n)
        print(f"{'ok  ' if ok else 'FAIL'} {n:24s} spark {ts:5.1f}s duck {td:5.1f}s {msg}", flush=True)
    print("failed:", failed)
