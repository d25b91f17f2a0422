"""Every query with SQL gives DuckDB's rows; every query runs."""

import duckdb
import pandas as pd
import pytest

from sightline.plans import catalog

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6) + 0.0
        elif df[c].dtype.kind in "iu":
            df[c] = df[c].astype(float)
    return sorted(map(tuple, df.astype(str).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, D).toPandas()
    if name in catalog.SQL:
        want = duck.sql(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    else:
        assert len(got)
