"""A query and its SQL over the same tables."""

import math
import os

import duckdb

TABLES = ("documents", "pages", "labels", "embeddings")


def same(spark, query, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")

    def rows(columns, cells):
        order = sorted(range(len(columns)), key=columns.__getitem__)
        plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
        return sorted(([plain(r[i]) for i in order] for r in cells), key=repr)

    got, want = query(spark, sf), con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
