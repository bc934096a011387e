"""Side-by-side comparison of the registered queries with their SQL twins in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def differences(db, df, sql: str) -> str:
    """Empty when both sides agree on columns, types of cells and values."""
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    expected, actual = rows_of(names, result.fetchall()), rows_of(df.columns, df.collect())
    if len(expected) != len(actual):
        return f"{len(actual)} rows against {len(expected)}"
    unequal = [(a, e) for a, e in zip(actual, expected)
               if a != e or [type(x) for x in a] != [type(x) for x in e]]
    return f"{len(unequal)} rows differ, first {unequal[0]}" if unequal else ""
