"""Run registered queries in Spark and their SQL twins in DuckDB and compare
(row count, column names, order-insensitive values). Usable from pytest and
as a script: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from tabsieve.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    return v


def rows_of(pdf: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    cols = sorted(pdf.columns)
    rows = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        rows.append(tuple(_norm(None if (not isinstance(x, (list, tuple, dict)) and not hasattr(x, "tolist") and pd.isna(x)) else x)
                          for x in rec))
    rows.sort(key=lambda r: repr(r))
    return cols, rows


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> tuple[bool, str]:
    sc, sr = rows_of(spark_pdf)
    dc, dr = rows_of(duck_pdf)
    if sc != dc:
        return False, f"columns differ: spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return False, f"row count differs: spark={len(sr)} duck={len(dr)}"
    for a, b in zip(sr, dr):
        if a != b:
            diff = [(c, x, y) for c, x, y in zip(sc, a, b) if x != y]
            return False, f"first differing row: {diff[:5]}"
    return True, f"{len(sr)} rows match"


def spark_pdf(df) -> pd.DataFrame:
    rows = df.collect()
    return pd.DataFrame([r.asDict(recursive=True) for r in rows], columns=df.columns)


def check(spark, sf_dir: str, names=None, verbose=True) -> dict[str, tuple[bool, str]]:
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = spark_pdf(qs[name](spark, sf_dir))
            t1 = time.time()
            if name in sqls:
                ddf = con.execute(sqls[name]).df()
                ok, msg = compare(sdf, ddf)
            else:
                ok, msg = True, f"rows-only: {len(sdf)} rows"
        except Exception as e:  # report and continue
            ok, msg, t1 = False, f"error: {type(e).__name__}: {str(e)[:600]}", time.time()
        out[name] = (ok, msg)
        if verbose:
            print(f"{'OK ' if ok else 'BAD'} {name:28s} {t1 - t0:6.2f}s  {msg}", flush=True)
    return out


if __name__ == "__main__":
    sys.path.insert(0, str(ROOT))
    from tabsieve.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_session("local[8]")
    res = check(spark, sf, names)
    bad = [n for n, (ok, _) in res.items() if not ok]
    print(f"{len(res) - len(bad)}/{len(res)} ok; bad: {bad}")
