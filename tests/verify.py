"""python tests/verify.py [--sf DIR] [NAME...]: runs queries and their SQL side by side and compares all values."""

import os
import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).parents[1]))
import __spark_entry__ as E
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cpus="8"):
    s = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def frame(df):
    df = df.reindex(sorted(df.columns), axis=1)
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].astype(float).round(6) + 0.0
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v) if not isinstance(v, (int, float, bool)) else v)
        elif "datetime" in str(df[c].dtype):
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


def compare(spark, con, name, sf):
    t = time.time()
    mine = E.queries()[name](spark, sf)
    got = frame(mine.toPandas())
    took = time.time() - t
    sql = E.oracle_sql().get(name)
    if not sql:
        return f"rows-only {len(got)}", took
    want = frame(con.sql(sql).df())
    if list(got.columns) != list(want.columns):
        return f"COLUMNS {list(got.columns)} {list(want.columns)}", took
    if len(got) != len(want):
        return f"ROWS {len(got)} {len(want)}", took
    for c in got.columns:
        a, b = got[c], want[c]
        if pd.api.types.is_numeric_dtype(a) and pd.api.types.is_numeric_dtype(b):
            bad = ~(np.isclose(a.astype(float), b.astype(float), rtol=1e-9, atol=1e-6, equal_nan=True))
        else:
            bad = (a.astype(str) != b.astype(str)) & ~(a.isna() & b.isna())
        if bad.any():
            k = int(np.argmax(np.asarray(bad)))
            return f"VALUES {c} ({int(bad.sum())}): {got.iloc[k].to_dict()} {want.iloc[k].to_dict()}"[:900], took
    return f"ok {len(got)}", took


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args[args.index("--sf") + 1] if "--sf" in args else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("--") and a != sf] or list(E.queries())
    names = [x for n in names for x in (E.queries() if n not in E.queries() else [n]) if x == n or x.startswith(n)]
    spark, con, bad = session(), connect(sf), 0
    for n in names:
        try:
            said, took = compare(spark, con, n, sf)
        except Exception as e:  # report and go on
            said, took = "ERROR " + str(e)[:1500], 0
        bad += not said.startswith(("ok", "rows-only"))
        print(f"{n:40s} {took:6.2f}s {said}", flush=True)
    sys.exit(bad)
