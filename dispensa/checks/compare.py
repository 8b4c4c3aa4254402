"""Run registered queries and their DuckDB oracle side by side.

``python -m dispensa.checks.compare [sf_dir] [name ...]`` prints one line per
query: rows, column match and value match (order-insensitive multiset of rows
with columns sorted by name).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _key(row):
    return tuple((x is None, type(x).__name__, str(x)) for x in row)


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare_one(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(_norm(r[c]) for c in s_cols) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return {"name": name, "rows": len(s_rows), "oracle": None, "sec": round(t1 - t0, 2)}
    res = con.execute(sql)
    o_cols = [d[0] for d in res.description]
    o_rows = [tuple(_norm(x) for x in r) for r in res.fetchall()]
    ok_cols = sorted(s_cols) == sorted(o_cols)
    s_idx = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    o_idx = sorted(range(len(o_cols)), key=lambda i: o_cols[i])
    s_set = sorted((tuple(r[i] for i in s_idx) for r in s_rows), key=_key)
    o_set = sorted((tuple(r[i] for i in o_idx) for r in o_rows), key=_key)
    ok_vals = ok_cols and s_set == o_set
    out = {"name": name, "rows": len(s_rows), "oracle_rows": len(o_rows), "cols": ok_cols,
           "values": ok_vals, "sec": round(t1 - t0, 2)}
    if not ok_cols:
        out["spark_cols"] = s_cols
        out["oracle_cols"] = o_cols
    elif not ok_vals:
        s_only = [r for r in s_set if r not in set(o_set)][:3]
        o_only = [r for r in o_set if r not in set(s_set)][:3]
        out["spark_only"] = s_only
        out["oracle_only"] = o_only
    return out


def main(argv):
    import os
    sys.path.insert(0, os.getcwd())
    from dispensa.session import build_session, ensure_checkpoint_dir
    from dispensa.queries import REGISTRY
    from dispensa.checks.oracle_sql import ORACLE
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(REGISTRY)
    extra = {"spark.sql.session.timeZone": os.environ["DISPENSA_TZ"]} if os.environ.get("DISPENSA_TZ") else None
    spark = build_session("local[8]", 8, extra=extra)
    ensure_checkpoint_dir(spark)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare_one(spark, con, n, REGISTRY[n], ORACLE.get(n), sf_dir)
        except Exception as e:  # report and go on
            r = {"name": n, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        if "error" in r or r.get("values") is False:
            bad += 1
        print(r, flush=True)
    print(f"done: {len(names)} queries, {bad} failing")
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main(sys.argv[1:]) else 0)
