"""Run Spark queries and their DuckDB twins side by side and compare.

Usable from pytest (``compare``) and as a script:
    python tests/oracle_check.py /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "benchmark", "embeddings",
    "conversations", "labels",
]

_SPARK_TO_DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        # exact: the Spark and DuckDB results agree to the last bit (and in the sign of zero)
        return "NaN" if math.isnan(v) else repr(v)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, con, sf_dir: str, key: str, build, sql: str) -> tuple[bool, str]:
    df = build(spark, sf_dir)
    s_cols = df.columns
    s_types = [f.dataType.simpleString() for f in df.schema.fields]
    s_rows = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = [str(t) for t in rel.types]
    d_rows = rel.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={s_cols} duck={d_cols}"
    s_map = dict(zip(s_cols, s_types))
    d_map = dict(zip(d_cols, d_types))
    bad = [c for c in s_cols if _SPARK_TO_DUCK.get(s_map[c], s_map[c]) != d_map[c]]
    if bad:
        return False, "types differ: " + ", ".join(f"{c}: spark {s_map[c]} / duck {d_map[c]}" for c in bad)
    if len(s_rows) != len(d_rows):
        return False, f"row count spark={len(s_rows)} duck={len(d_rows)}"
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ (cols {sorted(s_cols)}): {diff}"
    return True, f"{len(s_rows)} rows"


def main(argv: list[str]) -> int:
    from rosterlens.session import build_session

    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:]
    spark = build_session(master="local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    failures = 0
    keys = keys or [k for k in qs if k in sqls]
    for key in keys:
        t0 = time.time()
        try:
            ok, msg = compare(spark, con, sf_dir, key, qs[key], sqls[key])
        except Exception as e:  # report and go on
            ok, msg = False, f"error: {type(e).__name__}: {str(e)[:400]}"
        failures += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {key:32s} {time.time() - t0:6.2f}s {msg}", flush=True)
    print(f"{failures} failures of {len(keys)}")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
