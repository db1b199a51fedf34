"""Run registered queries on Spark and DuckDB and compare: ``python tests/check.py [sf_dir] [name prefix ...]``."""

import datetime
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb  # noqa: E402


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def connect(sf):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def compare(spark, con, sf, name, run, sql):
    t = time.time()
    df = run(spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    spent = time.time() - t
    if sql is None:
        return f"rows-only {len(got)}", spent, 0.0, True
    t = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = [dict(zip(names, r)) for r in cur.fetchall()]
    duck = time.time() - t
    if sorted(names) != cols:
        return f"columns differ {cols} {sorted(names)}", spent, duck, False
    want = sorted((tuple(norm(r[c]) for c in cols) for r in rows), key=repr)
    if got != want:
        a, b = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"DIFF {len(got)} vs {len(want)}\n   spark {a}\n   duck  {b}", spent, duck, False
    types = {k: v for k, v in df.dtypes}
    kinds = {d[0]: str(d[1]) for d in cur.description}
    odd = [(c, types[c], kinds[c]) for c in cols if not _alike(types[c], kinds[c])]
    return f"ok {len(got)}" + (f" TYPES {odd}" if odd else "") + (" EMPTY" if not got else ""), spent, duck, True


def _alike(a, b):
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    return pairs.get(a) == b


if __name__ == "__main__":
    import __spark_entry__ as entry
    from privacyframes.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark = build_session("local[8]", "check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, checks, bad = connect(sf), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if not name.startswith(prefixes):
            continue
        try:
            text, a, b, ok = compare(spark, con, sf, name, run, checks.get(name))
        except Exception as e:
            text, a, b, ok = f"ERROR {type(e).__name__} {str(e)[:700]}", 0, 0, False
        bad += not ok
        print(f"{name:36s} {a:6.2f}s {b:6.2f}s  {text}", flush=True)
    print("failures:", bad)
