"""Run registered Spark queries next to their DuckDB oracle and compare.

Usage: python tests/oracle_harness.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from recurra.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        # exact: the driver hashes values, so no tolerance here
        return repr(v)
    if hasattr(v, "tolist"):
        return str(v.tolist())
    if isinstance(v, (list, tuple, dict)):
        return str(v)
    return v


def rows_of(records, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict:
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            scols = sdf.columns
            srows = rows_of([tuple(r) for r in sdf.collect()], scols)
        except Exception as e:  # noqa: BLE001
            results[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            if verbose:
                print(name, results[name], flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = f"rows-only {len(srows)}"
            if verbose:
                print(f"{name}: {results[name]} ({ts:.1f}s)", flush=True)
            continue
        try:
            rel = con.sql(sqls[name])
            dcols = rel.columns
            drows = rows_of(rel.fetchall(), dcols)
        except Exception as e:  # noqa: BLE001
            results[name] = f"SQL ERROR {str(e)[:300]}"
            if verbose:
                print(name, results[name], flush=True)
            continue
        if sorted(scols) != sorted(dcols):
            results[name] = f"COLUMNS {sorted(scols)} vs {sorted(dcols)}"
        elif len(srows) != len(drows):
            results[name] = f"ROWCOUNT spark={len(srows)} sql={len(drows)}"
        elif srows != drows:
            diff = [(a, b) for a, b in zip(srows, drows) if a != b][:3]
            results[name] = f"VALUES differ e.g. {diff}"
        else:
            results[name] = f"OK {len(srows)} rows"
        if verbose:
            print(f"{name}: {results[name]} ({ts:.1f}s)", flush=True)
    return results


if __name__ == "__main__":
    from recurra.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark("local[8]", 8)
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if not (v.startswith("OK") or v.startswith("rows-only"))}
    print(f"{len(res) - len(bad)}/{len(res)} ok")
    for k, v in bad.items():
        print("BAD", k, v)
