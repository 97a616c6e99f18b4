"""Runs a query and its SQL side by side."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


def _plain(x):
    if isinstance(x, float):
        return "null" if x != x else str(int(x)) if x.is_integer() else repr(x)
    if x is None or x is pd.NaT or x is pd.NA:
        return "null"
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return str([_plain(v) for v in x])
    return str(x)


def rows(pdf: pd.DataFrame) -> list[tuple[str, ...]]:
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(_plain(v) for v in r) for r in pdf.astype(object).itertuples(index=False))


def difference(df, sql: str, sf_dir: str) -> str:
    """What the rows of df and of the SQL differ in; empty when they are the same."""
    got, want = df.toPandas(), connection(sf_dir).sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a == b:
        return ""
    return f"{len(a)} and {len(b)} rows; only here {[x for x in a if x not in set(b)][:2]}; only there {[x for x in b if x not in set(a)][:2]}"
