"""Spark vs DuckDB comparison used by the tests and by hand.

Mirrors the driver's gate: row count, column names (sorted), and an
order-insensitive multiset of rows with columns in name order.  Doubles are
compared after rounding to ``digits`` significant places, so last-bit noise
of unrounded sums does not count as a mismatch while any real difference
does.
"""

from __future__ import annotations

import datetime as dt
import math
import sys
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits: int):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if v == 0:
            return 0.0
        return float(f"{v:.{digits}g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "as_integer_ratio") and not isinstance(v, int):  # Decimal
        return float(f"{float(v):.{digits}g}")
    return v


def rows_multiset(columns: list[str], rows, digits: int) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_norm(r[i], digits) for i in order) for r in rows)


def compare(spark, con, key: str, fn, sql: str, sf_dir: str, digits: int = 17) -> dict:
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    out = {
        "key": key,
        "rows": (len(s_rows), len(d_rows)),
        "cols_match": sorted(s_cols) == sorted(d_cols),
    }
    if out["cols_match"]:
        a = rows_multiset(s_cols, s_rows, digits)
        b = rows_multiset(d_cols, d_rows, digits)
        out["values_match"] = a == b
        if a != b:
            out["only_spark"] = list((a - b).elements())[:3]
            out["only_duck"] = list((b - a).elements())[:3]
            out["sorted_cols"] = sorted(s_cols)
    else:
        out["values_match"] = False
        out["spark_cols"], out["duck_cols"] = s_cols, d_cols
    return out


def main(argv: list[str]) -> int:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from tierline.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for key, fn in qs.items():
        if only and key not in only:
            continue
        if key not in oracle:
            print(f"{key:30s} (no oracle)")
            continue
        try:
            res = compare(spark, con, key, fn, oracle[key], sf_dir)
        except Exception as e:  # report and continue
            bad += 1
            print(f"{key:30s} ERROR {type(e).__name__}: {str(e)[:400]}")
            continue
        ok = res["values_match"] and res["rows"][0] == res["rows"][1]
        bad += not ok
        print(f"{key:30s} {'OK ' if ok else 'BAD'} rows={res['rows']}", "" if ok else res)
    print("mismatches:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
