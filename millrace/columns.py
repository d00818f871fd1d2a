"""Names that do not clash with a user's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(df: DataFrame, base: str) -> str:
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"{base}_"
    return base
