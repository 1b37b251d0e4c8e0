"""Size checks in front of broadcasts and static filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def rows_if_few(df: DataFrame, most: int) -> list[Row] | None:
    """All rows where there are at most ``most`` of them, else None.

    Looks at no more than ``most + 1`` rows, so the driver never holds a table
    whose size nobody checked. Callers keep an exact plan for the None case.
    """
    rows = df.take(most + 1)
    return rows if len(rows) <= most else None


def broadcast_if_few(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast hint only for a side already counted to be small."""
    return F.broadcast(df) if rows <= most else df
