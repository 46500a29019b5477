"""Spark's rows against DuckDB's, in any order; columns by name."""

import glob
import math
import os

import duckdb


def connection(sf_dir):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return float(f"{float(value):.9g}")
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def compare(df, db, sql):
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    done = db.execute(sql)
    names, want = rows_of([c[0] for c in done.description], done.fetchall())
    assert got_names == names
    assert len(got) == len(want), (len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not bad, bad[:3]
