"""Compare registered queries with their SQL checks; also a command line: python -m tests.checks SF [name ...]."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from attesta.sources.adapters import RAW_TABLES

TESTDATA = "/root/testdata"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(df, con, sql: str) -> tuple[str | None, int]:
    """None when equal, else a short description of the first difference; plus the row count."""
    cur = con.execute(sql)
    want_cols, want = _rows([d[0] for d in cur.description], cur.fetchall())
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if got != want:
        a = [r for r in got if r not in set(want)][:2] if len(got) < 200000 else []
        b = [r for r in want if r not in set(got)][:2] if len(want) < 200000 else []
        return f"rows {len(got)} vs {len(want)}; only spark {a}; only check {b}", len(got)
    return None, len(got)


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from attesta.session import build_session

    sf_dir = f"{TESTDATA}/sf{argv[0]}"
    names = argv[1:]
    spark = build_session("checks", master="local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in sqls:
                problem, n = compare(df, con, sqls[name])
            else:
                problem, n = None, len(df.collect())
                name += " (no sql)"
        except Exception as exc:  # report and go on with the next query
            problem, n = f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:38s} rows={n:<8d} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
