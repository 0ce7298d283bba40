"""Run registered queries in Spark and their SQL oracles in DuckDB, compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: name, status, rows (spark / oracle), seconds.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if math.isinf(v):
            return v
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, bytes | bytearray):
        return bytes(v)
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def compare(spark_df, con, sql):
    sp_cols = spark_df.columns
    sp = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    dk_cols = [c for c in rel.columns]
    dk = rel.fetchall()
    if sorted(sp_cols) != sorted(dk_cols):
        return "COLS", len(sp), len(dk), f"{sorted(sp_cols)} vs {sorted(dk_cols)}"
    a, b = rows_of(sp_cols, sp), rows_of(dk_cols, dk)
    if len(a) != len(b):
        return "ROWCOUNT", len(a), len(b), ""
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return "VALUES", len(a), len(b), repr(diff)[:600]
    return "OK", len(a), len(b), ""


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from quire.session import get_session
    import __spark_entry__ as e
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(sf)
    qs, ors = e.queries(), e.oracle_sql()
    bad = 0
    for n in (names or list(qs)):
        t = time.time()
        try:
            df = qs[n](spark, sf)
            if n in ors:
                st, a, b, msg = compare(df, con, ors[n])
            else:
                a = df.count()
                st, b, msg = "ROWS-ONLY", -1, ""
        except Exception as ex:  # noqa: BLE001
            st, a, b, msg = "ERROR", -1, -1, repr(ex)[:800]
        if st not in ("OK", "ROWS-ONLY"):
            bad += 1
        print(f"{n:28s} {st:9s} {a:>7} {b:>7} {time.time() - t:6.2f}s {msg}", flush=True)
    print("FAILED", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
