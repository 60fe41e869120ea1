"""A query and its SQL, side by side."""

import os
from glob import glob

import duckdb
import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"


def connect(sf: str = SF):
    con = duckdb.connect()
    for f in glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return int(x)
    return round(float(x), 6) + 0.0 if isinstance(x, (float, np.floating)) else str(x)


def rows(df: pd.DataFrame):
    columns = sorted(df.columns)
    out = []
    for r in df[columns].itertuples(index=False, name=None):
        values = [plain(x) for x in r]
        out.append(repr([int(v) if isinstance(v, float) and v == int(v) else v for v in values]))
    return columns, sorted(out)


def check(spark, con, query, sql, sf: str = SF):
    assert rows(query(spark, sf).toPandas()) == rows(con.sql(sql).df())
