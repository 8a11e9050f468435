"""Runs registered queries against their SQL in DuckDB on the same tables."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def same(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty if both hold the same rows, in any order; else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {list(got.columns)}, {list(want.columns)}"
    cols = sorted(got.columns)
    if len(got) != len(want):
        return f"{len(got)} rows, {len(want)} wanted"
    a, b = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    for c in cols:
        if pd.api.types.is_float_dtype(b[c]) or pd.api.types.is_float_dtype(a[c]):
            bad = ~((a[c].astype(float) - b[c].astype(float)).abs().le(1e-6) | (a[c].isna() & b[c].isna()))
        else:
            bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if bad.any():
            return f"{c}: {a[c][bad].iloc[0]!r}, wanted {b[c][bad].iloc[0]!r} ({int(bad.sum())} rows)"
    return ""
