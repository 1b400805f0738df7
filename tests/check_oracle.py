"""Run registered queries beside their SQL in DuckDB and compare rows.

    python tests/check_oracle.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        return ("DECIMAL", str(v))
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def compare(spark, con, sf, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf)
    got = df.collect()
    took = time.time() - t0
    if sql is None:
        return f"rows-only {len(got)}", took
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want, wc = rows_of(cols, res.fetchall())
    have, hc = rows_of(df.columns, [tuple(r) for r in got])
    if wc != hc:
        return f"FAIL columns {hc} vs {wc}", took
    if len(want) != len(have):
        extra = list(set(have) - set(want))[:2]
        miss = list(set(want) - set(have))[:2]
        return f"FAIL rows {len(have)} vs {len(want)} extra={str(extra)[:400]} missing={str(miss)[:400]}", took
    if want != have:
        bad = [(a, b) for a, b in zip(have, want) if a != b]
        return f"FAIL {len(bad)} of {len(have)} rows; e.g. {hc} {str(bad[0][0])[:500]} vs {str(bad[0][1])[:500]}", took
    kinds = {c: type(v).__name__ for c, v in zip(hc, have[0])} if have else {}
    kinds2 = {c: type(v).__name__ for c, v in zip(wc, want[0])} if want else {}
    note = f" TYPES {[(c, kinds[c], kinds2[c]) for c in kinds if kinds[c] != kinds2[c]]}" if kinds != kinds2 else ""
    return f"ok {len(have)}{note}", took


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from caseloom.session import local_session

    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.001"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed, empty = duck(sf), oracle_sql(), 0, []
    for name, fn in queries().items():
        if len(args) > 1 and not any(name.startswith(a) for a in args[1:]):
            continue
        try:
            out, took = compare(spark, con, sf, name, fn, sqls.get(name))
        except Exception as exc:
            out, took = f"FAIL {type(exc).__name__}: {str(exc)[:700]}", 0.0
            if "-v" in args:
                traceback.print_exc()
        failed += out.startswith("FAIL")
        print(f"{name:34s} {took:6.1f}s {out}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
