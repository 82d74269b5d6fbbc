"""Spark job vs DuckDB oracle, compared the way the correctness gate does:
columns sorted by name, rows order-insensitive, values exact.

Usage: python -m tests.oracle_harness [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

DRIVER_VIEWS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    import os
    con = duckdb.connect()
    for t in DRIVER_VIEWS:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):                 # a folder written by Spark
            path = f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _scalar(v):
    if v is None or (not isinstance(v, str) and pd.isna(v)):
        return None
    if isinstance(v, pd.Timestamp) and v == v.normalize():
        return str(v.date())
    return str(v)


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime") or df[c].dtype == object:
            df[c] = df[c].map(_scalar)
    key = df.astype(str)
    return df.loc[key.sort_values(list(key.columns)).index].reset_index(drop=True)


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    from __spark_entry__ import oracle_sql, queries
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = queries()[name](spark, sf_dir)
    s = sdf.toPandas()
    t1 = time.time()
    sql = oracle_sql().get(name)
    if sql is None:
        return {"name": name, "rows": len(s), "oracle": None, "spark_s": round(t1 - t0, 2)}
    o = con.execute(sql).df()
    t2 = time.time()
    res = {"name": name, "rows": len(s), "oracle_rows": len(o), "spark_s": round(t1 - t0, 2),
           "duck_s": round(t2 - t1, 2)}
    if sorted(s.columns) != sorted(o.columns):
        res["match"] = False
        res["why"] = f"columns {sorted(set(s.columns) ^ set(o.columns))}"
        return res
    a, b = _norm(s), _norm(o)
    if len(a) != len(b):
        res["match"] = False
        res["why"] = "row count"
        return res
    diff = []
    for c in a.columns:
        x, y = a[c], b[c]
        neq = ~((x == y) | (x.isna() & y.isna()))
        if neq.any():
            i = neq.idxmax()
            diff.append(f"{c}: {int(neq.sum())} rows, e.g. {x[i]!r} vs {y[i]!r}")
    res["match"] = not diff
    if diff:
        res["why"] = "; ".join(diff)
    res["spark_types"] = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    return res


def main(argv):
    from shelfspark.session import local_session
    from __spark_entry__ import queries
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(queries())
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": n, "error": repr(e)[:800]}
        bad += not r.get("match", r.get("oracle", 1) is None)
        print(r, flush=True)
    print("mismatches:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
