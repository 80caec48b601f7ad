"""Runs a query and its SQL on the same tables and compares the rows."""

import glob
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(found):
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted(repr(tuple(plain(v) for v in r)) for r in found)


def same(df, c, sql):
    cols = sorted(df.columns)
    want = c.sql(f"SELECT {', '.join(chr(34) + x + chr(34) for x in cols)} FROM ({sql})").fetchall()
    assert rows(df.select(*cols).collect()) == rows(want)
