"""The key index: a flat table of ``(part, *keys)`` already loaded.

The index is one row per key tuple, so it is an ordinary column-pruned,
partition-pruned Parquet table.  A per-partition key *set* (one row holding
every key of a partition) is deliberately not offered: a partition's keys are
unbounded and must never be gathered into one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from increload.functions.keys import as_list


def _index_cols(part: str | None, keys: str | Sequence[str]) -> list[str]:
    keys = as_list(keys)
    if not keys:
        raise ValueError("at least one primary key column is required")
    return [part, *keys] if part is not None else keys


def select_keys(df: DataFrame, part: str | None, keys: str | Sequence[str]) -> DataFrame:
    """Project a table onto its partition and key columns (native types kept)."""
    return df.select(*_index_cols(part, keys))


def build_key_index(df: DataFrame, part: str | None, keys: str | Sequence[str]) -> DataFrame:
    """Distinct ``(part, *keys)`` of a table: the index of a batch, or of a
    master table whose stored index is lost.  Partial + final aggregate."""
    return select_keys(df, part, keys).distinct()


def merge_key_index(*indexes: DataFrame) -> DataFrame:
    """Set union of key indexes (n-ary)."""
    if not indexes:
        raise ValueError("merge_key_index needs at least one index")
    cols = indexes[0].columns
    merged = reduce(lambda a, b: a.unionByName(b.select(*cols)), indexes[1:], indexes[0])
    return merged.distinct()


def index_profile(index: DataFrame, part: str, keys: str | Sequence[str]) -> DataFrame:
    """Per partition value: number of keys and the smallest key tuple.

    Output columns: ``part``, ``n_keys``, ``min_<key>`` for each key.
    """
    keys = as_list(keys)
    smallest = F.min(F.struct(*keys)).alias("__min")
    return index.groupBy(part).agg(F.count(F.lit(1)).alias("n_keys"), smallest).select(
        part, "n_keys", *[F.col("__min").getField(k).alias(f"min_{k}") for k in keys]
    )


def batch_partitions(df: DataFrame, part: str) -> DataFrame:
    """Distinct partition values of a batch (null included)."""
    return df.select(part).distinct()


def partition_count(df: DataFrame, part: str) -> DataFrame:
    """One row, ``n_partitions``: distinct partition values, a null counting as one."""
    return batch_partitions(df, part).agg(F.count(F.lit(1)).alias("n_partitions"))
