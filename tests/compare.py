"""Run registered queries on Spark and DuckDB and compare the results."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return f"{v + 0.0:.6f}"
    return v if v is None else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences as text; empty if both sides agree on columns, kinds and values."""
    result = con.execute(sql)
    d_columns = [c[0] for c in result.description]
    d_rows = result.fetchall()
    s_rows = [tuple(r) for r in spark_df.collect()]
    problems = []
    if sorted(d_columns) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} vs {sorted(d_columns)}"]
    for c in d_columns:
        kinds = [
            {type(r[cols.index(c)]).__name__ for r in rows} - {"NoneType"}
            for cols, rows in ((spark_df.columns, s_rows), (d_columns, d_rows))
        ]
        if kinds[0] != kinds[1] and all(kinds):
            problems.append(f"column {c}: {kinds[0]} vs {kinds[1]}")
    a, b = rows_of(spark_df.columns, s_rows), rows_of(d_columns, d_rows)
    if len(a) != len(b):
        problems.append(f"{len(a)} rows vs {len(b)}")
    only_a, only_b = sorted(set(a) - set(b), key=repr), sorted(set(b) - set(a), key=repr)
    if only_a or only_b:
        problems.append(f"spark only {len(only_a)}: {only_a[:3]}\n   duck only {len(only_b)}: {only_b[:3]}")
    elif a != b:
        problems.append("same distinct rows, other multiplicities")
    return problems
