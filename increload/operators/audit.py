"""Does the data keep what incremental loads assume of it?

A load relies on two promises: a row delivered again is the same row, and a
key stays in one partition.  A key that breaks the first loses the changed
payload silently, one that breaks the second is loaded once per partition.
Nothing in a load notices either; these reports do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from increload.functions.keys import KEY_COLS, as_list, packed_key, with_packed_key
from increload.operators.antijoin import DEFAULT_BROADCAST_BUDGET, fits, key_bytes_bound, matched_keys, profile_batch


def payload_hash(schema: T.StructType, cols: Sequence[str]) -> Column:
    """64-bit hash of a row's payload; equal payloads have equal hashes.  Maps
    and variants, which cannot be hashed, go as sorted entries or as JSON."""

    def hashable(c: str) -> Column:
        dtype = schema[c].dataType
        if isinstance(dtype, T.MapType):
            return F.array_sort(F.transform(F.map_entries(c), lambda e: F.to_json(e)))
        return F.to_json(c) if _holds_unhashable(dtype) else F.col(c)

    return F.xxhash64(*[hashable(c) for c in cols]) if cols else F.lit(0).cast("long")


def _holds_unhashable(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return True
    if isinstance(dtype, T.ArrayType):
        return _holds_unhashable(dtype.elementType)
    return isinstance(dtype, T.StructType) and any(_holds_unhashable(f.dataType) for f in dtype.fields)


def _of_batch(loaded: DataFrame, batch: DataFrame, keys: Sequence[str], budget: int) -> DataFrame:
    """Rows of ``loaded`` whose key the batch holds.  Keys of a small batch
    (checked) are broadcast; a large one meets the loaded keys in a semi-join."""
    packed, asked = with_packed_key(loaded, keys), batch.select(*packed_key(batch.schema, keys))
    if key_bytes_bound(batch.schema, keys) is not None and fits(batch.schema, keys, profile_batch(batch, None, keys), budget):
        return packed.join(F.broadcast(asked), on=KEY_COLS, how="left_semi").drop(*KEY_COLS)
    wanted = matched_keys(packed, asked).distinct()
    return packed.join(wanted, on=KEY_COLS, how="left_semi").drop(*KEY_COLS)


def audit_assumptions(
    batch: DataFrame, part: str | None, keys: str | Sequence[str], loaded: DataFrame | None = None,
    broadcast_budget: int = DEFAULT_BROADCAST_BUDGET,
) -> DataFrame:
    """Keys of ``batch`` that break an assumption, one row each:

    ``(*keys, n_rows, n_payload_conflicts, n_partitions, first_partition, last_partition)``

    * ``n_rows``: rows of the key in the batch;
    * ``n_payload_conflicts``: partitions of the batch in which the key comes
      with different payloads, among themselves or against the row loaded
      there (known if ``loaded`` has the payload columns, as the master has);
    * ``n_partitions``, with the smallest and largest value: partitions the key
      lies in, in the batch or in ``loaded`` (the master, or the key index).  A
      null partition is one too, but never the first or last.

    Keys are compared with nulls equal.  Payloads are compared by the smallest
    and largest 64-bit hash per key, so each task combines its rows to one row
    per key and partition before anything moves, however hot a key is.
    """
    keys = as_list(keys)
    if not keys:
        raise ValueError("at least one primary key column is required")
    ident = list(dict.fromkeys([*([part] if part is not None else []), *keys]))
    payload = [c for c in batch.columns if c not in ident]
    place = (F.col(part) if part is not None else F.lit(None).cast("int")).alias("__part")

    def side(df: DataFrame, here: bool, hashed: Column) -> DataFrame:
        return df.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], place, F.lit(int(here)).alias("__here"), hashed.alias("__hash"))

    rows = side(batch, True, payload_hash(batch.schema, payload))
    if loaded is not None:
        whole = set(payload) <= set(loaded.columns)
        met = _of_batch(loaded.select(*ident, *(payload if whole else [])), batch, keys, broadcast_budget)
        rows = rows.unionByName(side(met, False, payload_hash(met.schema, payload) if whole else F.lit(None).cast("long")))
    names = [f"__key{i}" for i in range(len(keys))]
    per_part = rows.groupBy(*names, "__part").agg(
        F.sum("__here").alias("__n"), F.min("__hash").alias("__low"), F.max("__hash").alias("__high")
    )
    differs = (F.col("__n") > 0) & (F.col("__low") != F.col("__high"))
    per_key = per_part.groupBy(*names).agg(
        F.sum("__n").alias("n_rows"), F.count_if(differs).alias("n_payload_conflicts"), F.count(F.lit(1)).alias("n_partitions"),
        F.min("__part").alias("first_partition"), F.max("__part").alias("last_partition"),
    )
    broken = per_key.where((F.col("n_rows") > 0) & ((F.col("n_payload_conflicts") > 0) | (F.col("n_partitions") > 1)))
    found = ["n_rows", "n_payload_conflicts", "n_partitions", "first_partition", "last_partition"]
    return broken.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], *found)
