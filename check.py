"""Compare registered queries with their SQL: python check.py [sf] [name-prefix ...]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from ledgerlens.plans.registry import load
from ledgerlens.session import build_session
from ledgerlens.sources.tables import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canon(df: pd.DataFrame) -> tuple[list[str], list[str], list[tuple]]:
    df = df[sorted(df.columns)]
    rows = sorted(tuple(repr(v) for v in row) for row in df.itertuples(index=False, name=None))
    return list(df.columns), [str(x) for x in df.dtypes], rows


def compare(a: pd.DataFrame, b: pd.DataFrame) -> str:
    ca, ta, ra = canon(a)
    cb, tb, rb = canon(b)
    if ca != cb:
        return f"columns {ca} != {cb}"
    if ta != tb:
        return f"types {[(c, x, y) for c, x, y in zip(ca, ta, tb) if x != y]}"
    if len(ra) != len(rb):
        return f"rows {len(ra)} != {len(rb)}"
    if ra != rb:
        bad = [(x, y) for x, y in zip(ra, rb) if x != y]
        return f"values differ in {len(bad)} rows, e.g. {bad[:2]}"
    return ""


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    folder = f"/root/testdata/sf{sf}"
    spark, con, bad = build_session("check"), connect(folder), 0
    for name, q in load().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            got = q(spark, folder).toPandas()
            t1 = time.time()
            if q.sql is None:
                msg, t2 = f"no SQL, {len(got)} rows", t1
            else:
                want = con.execute(q.sql).df()
                t2 = time.time()
                msg = compare(got, want)
                bad += bool(msg)
                msg = f"FAIL {msg}" if msg else f"ok {len(got)}"
                if not len(got):
                    msg += " EMPTY"
        except Exception as e:  # noqa: BLE001
            bad += 1
            t1 = t2 = time.time()
            msg = f"FAIL {type(e).__name__}: {str(e)[:600]}"
        print(f"{name:40s} {t1 - t0:6.2f}s {t2 - t1:6.2f}s {msg}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
