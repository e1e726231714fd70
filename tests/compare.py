"""Compare registered Spark queries with their SQL on the same Parquet tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from tessera.fixtures import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in sorted(v.items()))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(tuple(r)[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """(spark rows, sql rows, problem text or None)."""
    spark_rows = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    sql_rows = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return len(spark_rows), len(sql_rows), f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(spark_rows) != len(sql_rows):
        return len(spark_rows), len(sql_rows), "row count"
    for a, b in zip(spark_rows, sql_rows):
        if a != b:
            return len(spark_rows), len(sql_rows), f"first difference: {a} != {b}"
    return len(spark_rows), len(sql_rows), None
