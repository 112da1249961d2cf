"""Run a query and its SQL side by side."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str, tables: dict | None = None):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if tables and t in tables:
            con.register(f"_{t}", tables[t])
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM _{t}")
        elif os.path.isdir(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'")
        elif os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


def same(got, expected) -> None:
    a, b = normal(got), normal(expected)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    assert a.equals(b), a.compare(b).head(10).to_string()
