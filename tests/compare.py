"""Spark results against DuckDB's for the same tables."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def difference(query, sql: str, spark, sf_dir: str, con=None) -> str:
    """Empty if both give the same columns and rows, else what differs."""
    con = con or duck(sf_dir)
    df = query(spark, sf_dir)
    a_cols, a = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    b_cols, b = rows_of([d[0] for d in cur.description], cur.fetchall())
    if a_cols != b_cols:
        return f"columns {a_cols} and {b_cols}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows: {a[:2]} {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    return f"{len(bad)} of {len(a)} rows differ: {bad[:3]} of {a_cols}" if bad else ""
