"""Run a query and its DuckDB oracle over the same tables and compare the rows."""

import math
import os

import duckdb

DIR = "/root/testdata/sf0.01"


def connection(sf_dir=DIR):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda x: round(x, 9) + 0.0 if isinstance(x, float) and math.isfinite(x) else x
    return [columns[i] for i in order], sorted((tuple(fix(r[i]) for i in order) for r in data), key=repr)


def check(spark, con, query, sql, sf_dir=DIR):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con.execute(sql)
    want = rows([d[0] for d in con.description], con.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
