"""Every query with SQL is compared with DuckDB on the smallest tables; the others have to run."""

import datetime

import duckdb
import pandas as pd
import pytest

from tidemark import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(df, columns):
    def one(v):
        if v is None or (not isinstance(v, (list, dict, str)) and pd.isna(v)):
            return "<null>"
        if isinstance(v, float):
            return f"{v:.6f}"
        if isinstance(v, (datetime.date, pd.Timestamp)):
            return str(v).replace(" 00:00:00", "")
        return str(v)

    return df[columns].map(one).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    if name not in queries.ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = plain(got, columns), plain(want, columns)
    assert len(a) == len(b)
    assert a.equals(b), (a[(a != b).any(axis=1)].head(3).to_dict("records"), b[(a != b).any(axis=1)].head(3).to_dict("records"))
