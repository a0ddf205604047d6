"""Local stand-in for the driver's correctness gate.

Runs ``queries()[name]`` on Spark and ``oracle_sql()[name]`` on DuckDB over
the same parquet tables and compares row count, column names and an
order-insensitive hash of values (doubles rounded to 6 decimals).

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        r = round(v, 6)
        return repr(r + 0.0) if r != 0 else "0.0"
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, int) and not isinstance(v, bool):
        return repr(float(v)) if False else str(v)
    return str(v)


def table_hash(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest()


def duck_conn(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def check(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck_conn(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            s_cols = sdf.columns
            s_rows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK_ERROR", repr(e)[:300])
            if verbose:
                print(f"{name:32s} SPARK_ERROR {repr(e)[:300]}", flush=True)
            continue
        t1 = time.time()
        if name not in sqls:
            results[name] = ("ROWS_ONLY", len(s_rows))
            if verbose:
                print(f"{name:32s} rows-only n={len(s_rows)} spark={t1-t0:.1f}s", flush=True)
            continue
        try:
            rel = con.sql(sqls[name])
            d_cols = list(rel.columns)
            d_rows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = ("SQL_ERROR", repr(e)[:300])
            if verbose:
                print(f"{name:32s} SQL_ERROR {repr(e)[:300]}", flush=True)
            continue
        ok_n = len(s_rows) == len(d_rows)
        ok_c = sorted(s_cols) == sorted(d_cols)
        ok_h = ok_c and table_hash(s_cols, s_rows) == table_hash(d_cols, d_rows)
        status = "OK" if ok_n and ok_c and ok_h else "MISMATCH"
        results[name] = (status, len(s_rows), len(d_rows))
        if verbose:
            extra = "" if ok_c else f" cols spark-only={sorted(set(s_cols)-set(d_cols))[:5]} " \
                                    f"sql-only={sorted(set(d_cols)-set(s_cols))[:5]}"
            print(f"{name:32s} {status} rows={len(s_rows)}/{len(d_rows)} "
                  f"hash={'ok' if ok_h else 'DIFF'} spark={t1-t0:.1f}s{extra}", flush=True)
    return results


if __name__ == "__main__":
    from flowsentry.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark()
    res = check(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] not in ("OK", "ROWS_ONLY")]
    print("FAILED:", bad)
