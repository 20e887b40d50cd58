"""Row sets of a Spark query and of its DuckDB SQL, compared by value."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return float(round(x, 6))
    if hasattr(x, "item"):
        x = x.item()
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, query, sql: str, sf_dir: str) -> str:
    """An empty string where both give the same columns and rows."""
    df = query(spark, sf_dir)
    cur = connection(sf_dir).execute(sql)
    names, other = [c[0] for c in cur.description], cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, other)
    if a == b:
        return ""
    only_a, only_b = [r for r in a if r not in set(b)][:2] if len(a) < 60000 else a[:1], [r for r in b if r not in set(a)][:2] if len(a) < 60000 else b[:1]
    return f"{len(a)} and {len(b)} rows; {str(only_a)[:600]} | {str(only_b)[:600]}"
