"""Run registered keys on Spark and their oracle SQL on DuckDB; compare.

Mirrors the driver's check: same column names, same row count, same
order-insensitive multiset of values. Usage:

    python tests/oracle_compare.py /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from kestrel.sources.tables import TABLES  # noqa: E402

SPARK_TYPES = {
    "StringType": "string", "LongType": "bigint", "IntegerType": "int", "DoubleType": "double",
    "DateType": "date", "BooleanType": "boolean", "TimestampType": "timestamp",
    "TimestampNTZType": "timestamp", "ShortType": "smallint",
}
DUCK_TYPES = {
    "VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "DATE": "date",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp", "SMALLINT": "smallint",
}


def duck(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(base) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, base: str, key: str, fn, sql: str, con=None) -> dict:
    t0 = time.time()
    sdf = fn(spark, base)
    scols = sdf.columns
    stypes = {f.name: SPARK_TYPES.get(type(f.dataType).__name__, str(f.dataType)) for f in sdf.schema.fields}
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    con = con or duck(base)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    dtypes = {d[0]: DUCK_TYPES.get(str(d[1]), str(d[1])) for d in res.description}
    drows = res.fetchall()
    out = {"key": key, "spark_rows": len(srows), "oracle_rows": len(drows),
           "spark_sec": round(t1 - t0, 2)}
    out["cols_match"] = sorted(scols) == sorted(dcols)
    out["types_match"] = out["cols_match"] and all(stypes[c] == dtypes[c] for c in scols)
    if not out["types_match"]:
        out["schema"] = {"spark": stypes, "oracle": dtypes}
    out["values_match"] = out["cols_match"] and _rows(scols, srows) == _rows(dcols, drows)
    if out["cols_match"] and not out["values_match"]:
        a, b = _rows(scols, srows), _rows(dcols, drows)
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        out["first_diff"] = diff
    out["ok"] = out["types_match"] and out["values_match"] and len(srows) == len(drows)
    return out


def main(argv):
    base = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    import __spark_entry__ as E
    from kestrel.config import local_session
    spark = local_session("oracle-compare")
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(base)
    bad = 0
    for k in keys or sorted(qs):
        if k not in sqls:
            t0 = time.time()
            n = qs[k](spark, base).count()
            print(f"ROWS  {k}: {n} rows ({time.time() - t0:.1f}s)")
            continue
        try:
            r = compare(spark, base, k, qs[k], sqls[k], con)
        except Exception as e:  # report and continue
            bad += 1
            print(f"ERROR {k}: {type(e).__name__}: {str(e)[:400]}")
            continue
        tag = "OK   " if r["ok"] else "FAIL "
        bad += not r["ok"]
        print(tag, r)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
