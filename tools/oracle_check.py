"""Run registered queries on Spark and their DuckDB oracles side by side.

    python tools/oracle_check.py [--sf-dir DIR] [key ...]

Prints one line per key: rows (spark/oracle), column match, value match.
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from quarry.registry import all_oracles, all_queries  # noqa: E402
from quarry.session import TABLE_NAMES, build_session  # noqa: E402


STRICT = False


def norm(v):
    if v is None:
        return None
    try:
        import numpy as np
        if isinstance(v, np.generic):
            v = v.item()
    except Exception:
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if not STRICT:
            v = round(v, 6)
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(norm(x) for x in v.tolist())
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(norm(x) for x in rec))
    out.sort(key=repr)
    return cols, out


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def check(spark, con, sf_dir, key, fn, sql, verbose=False):
    t0 = time.time()
    sdf = fn(spark, sf_dir).toPandas()
    ts = time.time() - t0
    if sql is None:
        return dict(key=key, spark_rows=len(sdf), oracle_rows=None, ok=None, secs=ts)
    odf = con.execute(sql).df()
    sc, sr = rows_of(sdf)
    oc, orr = rows_of(odf)
    ok_cols = sc == oc
    ok_vals = ok_cols and sr == orr
    res = dict(key=key, spark_rows=len(sr), oracle_rows=len(orr), cols=ok_cols, ok=ok_vals, secs=ts)
    if not ok_vals and verbose:
        print("  spark cols", sc, list(sdf.dtypes))
        print("  oracle cols", oc, list(odf.dtypes))
        s1, s2 = set(sr), set(orr)
        print("  only spark", sorted(s1 - s2, key=repr)[:5])
        print("  only oracle", sorted(s2 - s1, key=repr)[:5])
    res["dtypes"] = [str(sdf[c].dtype) for c in sc] == [str(odf[c].dtype) for c in oc] if ok_cols else None
    return res


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("-v", action="store_true")
    ap.add_argument("--strict", action="store_true", help="compare floats exactly")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    global STRICT
    STRICT = a.strict
    spark = build_session()
    con = duck(a.sf_dir)
    qs, os_ = all_queries(), all_oracles()
    keys = a.keys or sorted(qs)
    bad = 0
    for k in keys:
        try:
            r = check(spark, con, a.sf_dir, k, qs[k], os_.get(k), a.v)
        except Exception as e:  # report and go on
            r = dict(key=k, error=f"{type(e).__name__}: {str(e)[:300]}")
        if r.get("ok") is False or "error" in r or r.get("dtypes") is False:
            bad += 1
        print(r, flush=True)
    print(f"bad={bad} of {len(keys)}")


if __name__ == "__main__":
    main()
