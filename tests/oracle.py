"""Side-by-side comparison of a Spark result and a DuckDB statement over the same folder."""

import glob
import math
import os
from collections import Counter

import duckdb


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        src = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{src}'")
    return con


def _key(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(_key(r[c]) for c in cols) for r in df.collect())


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_key(r[i]) for i in order) for r in cur.fetchall())
