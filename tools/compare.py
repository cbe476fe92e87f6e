"""Run registered queries on Spark and their SQL on DuckDB and compare the values.

usage: python tools/compare.py [--sf DIR] [--only REGEX] [--module NAME]
"""

from __future__ import annotations

import argparse
import math
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def normal(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v
    if hasattr(v, "as_tuple"):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def key(row):
    return tuple((x is None, str(type(x).__name__ if isinstance(x, bool) else ""), f"{x:.5f}" if isinstance(x, float) else str(x)) for x in row)


def table_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(normal(r[i]) for i in order) for r in rows), key=key)


def differs(a, b):
    if type(a) is bool or type(b) is bool:
        return a is not b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a != b
    return a != b


def compare(spark, con, sf, name, fn, sql):
    t = time.time()
    df = fn(spark, sf)
    got = table_rows(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t
    if sql is None:
        return True, f"rows={len(got[1])} (no SQL)", spent
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    odd = {c: (t, df.schema[c].dataType.simpleString()) for c, t in kinds.items() if c in df.columns and not same_type(t, df.schema[c].dataType.simpleString())}
    cur = con.execute(sql)
    want = table_rows([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}", spent
    if len(got[1]) != len(want[1]):
        extra = [r for r in got[1] if r not in set(want[1])][:3]
        return False, f"rows {len(got[1])} != {len(want[1])} e.g. only in spark: {extra}", spent
    bad = [(g, w) for g, w in zip(got[1], want[1]) if any(differs(x, y) for x, y in zip(g, w))]
    if bad:
        return False, f"{len(bad)}/{len(got[1])} rows differ: cols {got[0]}\n    spark {bad[0][0]}\n    duck  {bad[0][1]}", spent
    return not odd, f"rows={len(got[1])}" + (f" types {odd}" if odd else ""), spent


def same_type(duck, spark):
    exact = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "INTEGER": "int"}
    ints = {"BIGINT", "INTEGER", "SMALLINT", "TINYINT"}
    return exact.get(duck) == spark or (duck in ints and spark in ("bigint", "int", "smallint", "tinyint"))


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only", default=".*")
    ap.add_argument("--module", default=None)
    a = ap.parse_args()
    from vislens.plans.catalog import ORACLE, QUERIES
    from vislens.session import local_session

    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(a.sf)
    failed = []
    for name, fn in QUERIES.items():
        if not re.search(a.only, name) or (a.module and not fn.__module__.endswith(a.module)):
            continue
        try:
            ok, note, spent = compare(spark, con, a.sf, name, fn, ORACLE.get(name))
        except Exception as e:
            msg = str(e)
            ok, note, spent = False, f"{type(e).__name__}: {msg[:700]}", 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {spent:6.2f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print(f"failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
