"""Compare a query's rows with its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def differences(spark, query, sql, sf_dir=SF_DIR):
    """(names equal, rows only in Spark, rows only in SQL, number of rows)."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    db = connect(sf_dir)
    result = db.execute(sql)
    names = [c[0] for c in result.description]
    want = rows(names, result.fetchall())
    left, right = set(map(repr, got)), set(map(repr, want))
    return sorted(df.columns) == sorted(names), sorted(left - right)[:3], sorted(right - left)[:3], (len(got), len(want))
