"""Compares a Spark result with its SQL twin, run by DuckDB on the same tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "facility", "review", "review_subscore", "score", "metric_def", "sample_reviews", "sample_raw", "eval_items",
]


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(x: object) -> str:
    if x is None or (isinstance(x, float) and np.isnan(x)) or x is pd.NaT or x is pd.NA:
        return "null"
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(_cell, x)) + "]"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x)).lower()
    if isinstance(x, (int, np.integer)):
        return str(int(x))
    if isinstance(x, (float, np.floating)):
        return str(int(x)) if float(x).is_integer() else f"{float(x):.9g}"
    if isinstance(x, pd.Timestamp):
        return str(x.tz_localize(None) if x.tzinfo else x)
    return str(x)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    return sorted(tuple(map(_cell, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))


def difference(spark_frame: pd.DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None where both agree, else what differs."""
    other = con.execute(sql).df()
    if sorted(spark_frame.columns) != sorted(other.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(other.columns)}"
    a, b = rows(spark_frame), rows(other)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows of {len(a)}, as {bad[:3]}" if bad else None
