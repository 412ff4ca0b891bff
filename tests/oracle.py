"""Spark's rows beside DuckDB's."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"


def tables(sf_dir=DATA):
    d = duckdb.connect()
    for f in os.listdir(sf_dir):
        d.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{f}')")
    return d


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(map(str, frame[cols].itertuples(index=False, name=None)))
