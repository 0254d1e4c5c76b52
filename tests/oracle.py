"""Run a query and its SQL side by side, as the driver does."""

import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, sf_dir: str = DATA) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    text = lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    return sorted((tuple(text(v) for v in r) for r in df.itertuples(index=False)), key=str)


def compare(spark, query, sql: str, sf_dir: str = DATA) -> int:
    got, want = query(spark, sf_dir).toPandas(), duck(sql, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b):
        assert x == y
    return len(a)
