"""Runs every query that has SQL against DuckDB on the same tables and compares rows, whatever their order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(map(str, (tuple(round(r[i], 6) if isinstance(r[i], float) else str(r[i]) for i in order) for r in data)))


def difference(spark, con, f, sql, sf_dir):
    df, want = f(spark, sf_dir), con.sql(sql)
    a, b = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    if sorted(df.columns) != sorted(want.columns) or a != b:
        return f"{sorted(df.columns)} {sorted(want.columns)} {len(a)} {len(b)} {next(((x, y) for x, y in zip(a, b) if x != y), '')}"
    return ""
