"""Run every registered query in Spark and its oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive multiset of rows.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import __spark_entry__ as E  # noqa: E402
from regemb.session import get_spark  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_key(rows):
    return sorted((tuple(norm(x) for x in r) for r in rows), key=repr)


def compare(spark, con, name, sf_dir):
    qs, sqls = E.queries(), E.oracle_sql()
    t = time.time()
    sdf = qs[name](spark, sf_dir)
    cols = sorted(sdf.columns)
    srows = [tuple(r[c] for c in cols) for r in sdf.collect()]
    ts = time.time() - t
    if name not in sqls:
        return f"{name}: rows-only {len(srows)} ({ts:.1f}s)"
    res = con.sql(sqls[name])
    dcols = res.columns
    drows_raw = res.fetchall()
    if sorted(dcols) != cols:
        return f"{name}: COLUMN MISMATCH spark={cols} duck={sorted(dcols)}"
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}
    odd = {c: (k, str(t)) for (c, k), t in
           ((x, dict(zip(dcols, res.types))[x[0]]) for x in sdf.dtypes) if kinds.get(k) != str(t)}
    idx = [dcols.index(c) for c in cols]
    drows = [tuple(r[i] for i in idx) for r in drows_raw]
    a, b = rows_key(srows), rows_key(drows)
    if a == b:
        return f"{name}: OK {len(a)} rows ({ts:.1f}s)" + (f" TYPES {odd}" if odd else "")
    sa, sb = set(a), set(b)
    return (f"{name}: MISMATCH spark={len(a)} duck={len(b)}\n  only spark: {sorted(sa - sb, key=repr)[:5]}"
            f"\n  only duck: {sorted(sb - sa, key=repr)[:5]}")


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(E.queries())
    spark = get_spark("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for n in names:
        try:
            msg = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and go on
            msg = f"{n}: ERROR {type(e).__name__}: {str(e)[:600]}"
        if "OK" not in msg and "rows-only" not in msg:
            bad += 1
        print(msg, flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main()
