"""Runs a query and its SQL over the same tables and compares the rows."""

import glob
import os

import duckdb


def rounded(v):
    return round(v, 9) if isinstance(v, float) else v


def rows(columns, data):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(rounded(r[i]) for i in order) for r in data), key=repr)


def connection(sf_dir):
    out = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        out.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return out


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = df.collect()
    found = connection(sf_dir).execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, found.fetchall())
    return got
