"""Runs a query and its DuckDB oracle over one folder of tables and compares all rows."""

import datetime
import decimal
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else str(v)
    return v


def compare(spark, query, sql, folder):
    import duckdb

    df = query(spark, folder)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == sorted(str([plain(r[i]) for i in places]) for r in want.fetchall())
