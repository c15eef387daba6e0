"""Rows of a query beside those of its SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return found


def _key(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return (0, "")
    return (1, f"{value + 0.0:.9g}") if isinstance(value, (int, float)) and not isinstance(value, bool) else (1, str(value))


def difference(df, con, sql):
    """None if both have the same columns and rows, whatever their order."""
    names = sorted(df.columns)
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    if sorted(columns) != names:
        return f"columns {names} and {sorted(columns)}"
    a = sorted(tuple(_key(row[n]) for n in names) for row in df.collect())
    b = sorted(tuple(_key(row[columns.index(n)]) for n in names) for row in want.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    return next((f"{x} and {y}" for x, y in zip(a, b) if x != y), None)
