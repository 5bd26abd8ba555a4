"""Runs a query and its SQL on the same small tables."""

import glob
import math
import os

import duckdb

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def agree(spark, query, sql, d=SMALL):
    c = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df = query(spark, d)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = c.execute(sql)
    want = rows([x[0] for x in found.description], found.fetchall())
    assert sorted(df.columns) == sorted(x[0] for x in found.description)
    assert got == want
