"""Run a catalogue query and its SQL twin side by side."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def database(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def differences(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    rows = []
    for df in (ours, theirs):
        cols = sorted(df.columns)
        rows.append(sorted(map(repr, (tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False, name=None)))))
    wrong = [(a, b) for a, b in zip(*rows) if a != b]
    return f"{len(wrong)} of {len(ours)} rows differ, e.g. {wrong[0]}" if wrong else None


def plain(value):
    if value is None or value != value:
        return None
    return value.item() if hasattr(value, "item") else value


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: df[c].dtype.kind for c in df.columns}
