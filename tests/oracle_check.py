"""Run named queries on Spark and their DuckDB twins; compare row sets."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck_con(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def compare(spark, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sorted(sdf.columns)
    srows = sorted((tuple(_norm(r[c]) for c in scols) for r in sdf.collect()), key=repr)
    t1 = time.time()
    con = duck_con(sf_dir)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows_raw = res.fetchall()
    order = [dcols.index(c) for c in scols] if sorted(dcols) == scols else None
    t2 = time.time()
    if order is None:
        return False, f"columns differ: spark={scols} duck={sorted(dcols)}", t1 - t0, t2 - t1
    drows = sorted((tuple(_norm(r[i]) for i in order) for r in drows_raw), key=repr)
    if len(srows) != len(drows):
        return False, f"rows differ: spark={len(srows)} duck={len(drows)}", t1 - t0, t2 - t1
    for a, b in zip(srows, drows):
        if a != b:
            return False, f"first diff:\n spark={a!r}\n duck ={b!r}", t1 - t0, t2 - t1
    return True, f"{len(srows)} rows", t1 - t0, t2 - t1


if __name__ == "__main__":
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    from cartograph.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session()
    names = sys.argv[1:] or list(E.oracle_sql())
    qs, orc = E.queries(), E.oracle_sql()
    ok_all = True
    for n in names:
        if n not in orc:
            df = qs[n](spark, sf)
            print(f"{n:28s} ROWS-ONLY {df.count()} rows", flush=True)
            continue
        try:
            ok, msg, ts, td = compare(spark, n, qs[n], orc[n], sf)
        except Exception as e:  # report and go on
            ok, msg, ts, td = False, f"error: {e!r}"[:2000], 0, 0
        ok_all &= ok
        print(f"{n:28s} {'OK ' if ok else 'BAD'} spark={ts:6.1f}s duck={td:5.1f}s {msg}", flush=True)
    print("ALL OK" if ok_all else "SOME BAD")
