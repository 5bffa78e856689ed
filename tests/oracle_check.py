"""Run registered queries against their DuckDB SQL (same check as the driver).

usage: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v, digits=None):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, digits)) if digits is not None else repr(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x, digits) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x, digits)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def table_hash(columns, rows, digits=None):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i], digits) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    import __spark_entry__ as E
    from litsearch.session import local_session
    spark = local_session(8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for k in (keys or list(qs)):
        t0 = time.time()
        try:
            df = qs[k](spark, sf_dir)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{k:24s} SPARK ERROR {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in sqls:
            print(f"{k:24s} rows={len(s_rows):6d} (no oracle) {ts:6.1f}s")
            continue
        try:
            res = con.execute(sqls[k])
            d_cols = [c[0] for c in res.description]
            d_rows = [tuple(r) for r in res.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"{k:24s} SQL ERROR {str(e)[:400]}")
            bad += 1
            continue
        h1, l1 = table_hash(s_cols, s_rows)
        h2, l2 = table_hash(d_cols, d_rows)
        ok = sorted(s_cols) == sorted(d_cols) and len(s_rows) == len(d_rows) and h1 == h2
        note = ""
        if not ok:
            bad += 1
            r1, _ = table_hash(s_cols, s_rows, 6)
            r2, _ = table_hash(d_cols, d_rows, 6)
            note = f" cols={sorted(s_cols) == sorted(d_cols)} rounded6={'ok' if r1 == r2 else 'diff'}"
            if sorted(s_cols) != sorted(d_cols):
                note += f" spark={s_cols} sql={d_cols}"
            diff1 = sorted(set(l1) - set(l2))[:3]
            diff2 = sorted(set(l2) - set(l1))[:3]
            note += f"\n   spark-only: {diff1}\n   sql-only:   {diff2}"
        print(f"{k:24s} rows={len(s_rows):6d}/{len(d_rows):6d} {'MATCH' if ok else 'DIFF '} "
              f"{ts:6.1f}s{note}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
