"""Union / except helpers for building and checking increments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replay_split(df: DataFrame, is_existing: Column, is_replayed: Column) -> tuple[DataFrame, DataFrame]:
    """Split a table into (already loaded, new increment).

    ``existing`` holds the rows where ``is_existing`` is true.  The increment
    is every other row (a null condition counts as new) plus the existing
    rows where ``is_replayed`` is true, delivered a second time.
    """
    old = F.coalesce(is_existing, F.lit(False))
    existing = df.where(old)
    batch = df.where(~old).unionByName(df.where(old & F.coalesce(is_replayed, F.lit(False))))
    return existing, batch


def except_rows(df: DataFrame, other: DataFrame) -> DataFrame:
    """Distinct rows of ``df`` not in ``other`` (SQL ``EXCEPT DISTINCT``)."""
    return df.subtract(other.select(*df.columns))
