"""A query against its SQL in DuckDB."""

from __future__ import annotations

import glob
import os
from collections import Counter

DATA = "/root/testdata/sf0.001"


def shown(x):
    if isinstance(x, float):
        return "nan" if x != x else repr(x + 0.0)
    if isinstance(x, (list, tuple)):
        return [shown(y) for y in x]
    return repr(x)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, Counter(str(shown(tuple(r))) for r in df.select(*[f"`{c}`" for c in columns]).collect())


def sql_rows(text, folder=DATA):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    result = con.execute(text)
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), Counter(str(shown(tuple(r[i] for i in order))) for r in result.fetchall())
