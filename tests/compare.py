"""A query's rows against its SQL in DuckDB: sorted columns, any order of rows."""

from __future__ import annotations

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"create view {t} as select * from read_parquet('{path}')")
    return con


def plain(x):
    if x is None:
        return None
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return str(x)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    mine = df.collect()
    cursor = con.execute(sql)
    theirs = cursor.fetchall()
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    a, b = rows_of(df.columns, mine), rows_of(columns, theirs)
    if a != b:
        x, y = set(a) - set(b), set(b) - set(a)
        return f"{len(a)} and {len(b)} rows; {len(x)} only here, as {sorted(x, key=repr)[:3]}; {len(y)} only in SQL, as {sorted(y, key=repr)[:3]}"
    return ""
