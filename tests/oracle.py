"""Compare a query's rows with its SQL, column by column in name order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(os.path.join(sf_dir, "*.parquet"))):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def sort_key(row):
    return tuple((v is None, type(v).__name__, v if v is not None else 0) for v in row)


def spark_rows(df):
    names = sorted(df.columns)
    assert len(set(names)) == len(names), f"duplicate columns {names}"
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=sort_key)


def sql_rows(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    types = [str(d[1]) for d in cur.description]
    rows = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=sort_key)
    return [columns[i] for i in order], rows, [types[i] for i in order]


SPARK_TO_SQL = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def compare(df, con, sql):
    """Text of the first difference, or None."""
    names, got = spark_rows(df)
    sql_names, want, sql_types = sql_rows(con, sql)
    if names != sql_names:
        return f"columns {names} != {sql_names}"
    for n, t in zip(sql_names, sql_types, strict=True):
        mine = SPARK_TO_SQL.get(dict(df.dtypes)[n], dict(df.dtypes)[n])
        if mine != t:
            return f"type of {n}: {mine} != {t}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "both are empty"
    for g, w in zip(got, want, strict=True):
        if g != w:
            return f"first difference in {names}:\n  {g}\n  {w}"
    return None
