"""Run registered queries and their SQL checks side by side."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return ("",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int,)):
        return ("i", v)
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("f", round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_norm(x) for x in v))
    return ("s", str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else the first difference."""
    cols = spark_df.columns
    got = rows_of(cols, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    if sorted(cols) != sorted(want_cols):
        return f"columns {sorted(cols)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; e.g. {got[:1]} / {want[:1]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ ({sorted(cols)}): {bad[0]}"
    if not got:
        return "both empty"
    return None
