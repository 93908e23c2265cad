"""A query's rows against its SQL's, as the driver compares them."""

import os

import duckdb


def connection(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))


def assert_same(spark, sf, query, sql):
    assert rows(query(spark, sf).toPandas()) == rows(connection(sf).sql(sql).df())
