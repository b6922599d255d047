"""Compare a query with its DuckDB SQL."""

import os

import duckdb

SF = "/root/testdata/sf0.01"
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def same_as_sql(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    want = con.execute(sql)
    names = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(n) for n in names]
    rows = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    got = query(spark, sf)
    assert sorted(got.columns) == names
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == rows
    return rows
