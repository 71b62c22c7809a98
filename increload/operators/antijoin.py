"""Filter out rows whose key was already loaded (null-safe anti-join)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from increload.functions.keys import KEY_COLS, key_columns, packed_key, with_packed_key
from increload.session import shared_scratch

# Up to this many distinct partition values of a batch become literals of a
# filter; more are broadcast to the scan as a table.
DEFAULT_MAX_PRUNE_VALUES = 1000

# Largest table that is broadcast: the batch's keys, or its partition values.
DEFAULT_BROADCAST_BUDGET = 64 << 20

_FIXED_WIDTH = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.DateType: 4, T.FloatType: 4,
    T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8,
}


def _fixed_width(dtype: T.DataType) -> int | None:
    if isinstance(dtype, T.DecimalType):
        return 8 if dtype.precision <= 18 else 16
    return next((w for t, w in _FIXED_WIDTH.items() if isinstance(dtype, t)), None)


def _measured(dtype: T.DataType) -> bool:
    """Is the width of this type measured on the batch?"""
    return isinstance(dtype, (T.StringType, T.BinaryType))


def key_bytes_bound(schema: T.StructType, cols: Sequence[str], longest: int = 0) -> int | None:
    """Upper bound on the bytes one packed key takes in a broadcast hash
    relation, or ``None`` when a key column has neither a fixed width nor a
    measured one.  ``longest`` is the most that the string and binary columns
    of one row take together."""
    width = longest
    for c in cols:
        w = 0 if _measured(schema[c].dataType) else _fixed_width(schema[c].dataType)
        if w is None:
            return None
        width += 16 + max(w, 8)  # null-tracking word share, offset word, 8-byte aligned slot
    # row headers of the packed row and its struct, the hash, and a 2x
    # allowance for the hash map around the rows
    return 2 * (48 + width)


@dataclass(frozen=True)
class BatchProfile:
    """What one small job learns about a batch before planning the join.

    ``values``: its partition values as literal columns, nulls left out
    (``None``: too many, or not comparable as literals; then ``table`` holds
    them), ``counts``: rows of each, and of null, in the same form.
    ``has_null``: is a partition value null?  ``longest``: most bytes
    that the string and binary key columns of one row take.  ``tag``: a
    checksum of the keys, the same however the batch is partitioned.
    """

    n_rows: int
    longest: int
    tag: str
    values: list[Column] | None = None
    has_null: bool = False
    table: DataFrame | None = None
    counts: list[tuple[Column | None, int]] | None = None


def _collected(value: Column, dtype: T.DataType) -> Column:
    """A partition value in a form that Python keeps exactly.  Timestamps go
    as microseconds (their local time is ambiguous when clocks go back), dates
    and local timestamps as text (Python's have no years beyond 9999, and its
    local timestamps would be read in the driver's time zone)."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(dtype, (T.DateType, T.TimestampNTZType)):
        return value.cast("string")
    return value


def _literal(value, dtype: T.DataType) -> Column:
    """A collected partition value as a literal that equals the original."""
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(F.lit(value))
    return F.lit(value).cast(dtype)


def _collectable(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.DecimalType) or (
        isinstance(dtype, (T.StringType, T.BinaryType, *_FIXED_WIDTH)) and not isinstance(dtype, (T.FloatType, T.DoubleType))
    )


def profile_batch(
    batch: DataFrame, part: str | None, cols: Sequence[str], max_values: int = DEFAULT_MAX_PRUNE_VALUES
) -> BatchProfile:
    """Partition values, row count, key widths and key checksum of a batch.

    One aggregate per partition value.  At most ``max_values + 1`` rows reach
    the driver; beyond that the aggregate is written to the session's shared
    folder, and only its totals are collected.
    """
    schema = batch.schema
    widths = [F.coalesce(F.octet_length(c), F.lit(0)) for c in cols if _measured(schema[c].dataType)]
    longest = F.max(sum(widths, F.lit(0)))
    stats = [F.count(F.lit(1)).alias("n"), longest.alias("w"), F.bit_xor(F.xxhash64(*cols)).alias("x")]

    def made(n, w, x, **more) -> BatchProfile:
        return BatchProfile(int(n or 0), int(w or 0), f"{int(n or 0)}-{(x or 0) & (1 << 64) - 1:016x}", **more)

    if part is None:
        return made(*batch.agg(*stats).first())
    dtype = schema[part].dataType
    per_value = batch.groupBy(F.col(part).alias("value")).agg(*stats)
    if _collectable(dtype):
        rows = per_value.withColumn("value", _collected(F.col("value"), dtype)).limit(max_values + 1).collect()
        if len(rows) <= max_values:
            x = 0
            for r in rows:
                x ^= r["x"]
            counts = [(None if r["value"] is None else _literal(r["value"], dtype), int(r["n"])) for r in rows]
            values = [v for v, _ in counts if v is not None]
            return made(
                sum(r["n"] for r in rows), max([r["w"] for r in rows], default=0), x,
                values=values, has_null=len(values) < len(rows), counts=counts,
            )
    spark = batch.sparkSession
    path = shared_scratch(spark, "batch-values")
    per_value.write.parquet(path)
    table = spark.read.schema(per_value.schema).parquet(path)
    n, w, x, null = table.agg(F.sum("n"), F.max("w"), F.bit_xor("x"), F.count_if(F.col("value").isNull())).first()
    return made(n, w, x, has_null=bool(null), table=table.select("value", "n"))


def prune_to_profile(keys_df: DataFrame, part: str, profile: BatchProfile, budget: int = DEFAULT_BROADCAST_BUDGET) -> DataFrame:
    """``keys_df`` restricted to the partition values of a profiled batch.

    Few values become an ``IN`` filter, which prunes directories and row
    groups when the scan is planned.  Many are joined as a table on plain
    equality; when their measured size fits ``budget`` they are broadcast, so
    that Spark prunes the scan's directories at run time by the same values.
    A null value is kept by an ``IS NULL`` branch of its own.
    """
    col = F.col(part)
    if profile.values is not None:
        cond = col.isin(*profile.values) if profile.values else F.lit(False)
        return keys_df.where(cond | col.isNull() if profile.has_null else cond)
    # n > 0 holds for every row; it tells the optimizer that the table selects
    wanted = profile.table.where((F.col("n") > 0) & F.col("value").isNotNull()).select("value")
    size = profile.table.agg(F.sum(F.lit(64) + _value_bytes(profile.table))).first()[0] or 0
    if size <= budget:
        wanted = F.broadcast(wanted)
    out = keys_df.join(wanted, col == wanted["value"], "left_semi")
    return out.unionByName(keys_df.where(col.isNull())) if profile.has_null else out


def _value_bytes(table: DataFrame) -> Column:
    dtype = table.schema["value"].dataType
    if _measured(dtype):
        return F.coalesce(F.octet_length("value"), F.lit(0))
    return F.lit(_fixed_width(dtype) or 1 << 40)  # other types are not broadcast


def prune_to_batch_partitions(
    keys_df: DataFrame,
    batch: DataFrame,
    part: str,
    max_values: int = DEFAULT_MAX_PRUNE_VALUES,
    budget: int = DEFAULT_BROADCAST_BUDGET,
) -> DataFrame:
    """Restrict a key table (or master) to the partition values the batch touches.

    Spark's dynamic partition pruning does not fire for a left-anti join, so
    without this step the whole key table is scanned.  Only valid for
    partition-scoped matching.
    """
    return prune_to_profile(keys_df, part, profile_batch(batch, part, [part], max_values), budget)


def anti_on(batch: DataFrame, known: DataFrame, key_cols: Sequence[str] = KEY_COLS) -> DataFrame:
    """``batch`` rows whose prepared ``key_cols`` are absent from ``known``.

    Plain equality on the packed key: null-safe per field, and hashed on the
    same expressions the dedup grouped by, so no second shuffle of the batch.
    AQE turns it into a broadcast join when the known side is small at run
    time and splits skewed partitions of the batch side otherwise.
    """
    key_cols = list(key_cols)
    return batch.join(known.select(*key_cols), on=key_cols, how="left_anti")


def anti_on_broadcast_keys(
    batch: DataFrame, known: DataFrame, batch_keys: DataFrame, key_cols: Sequence[str] = KEY_COLS
) -> DataFrame:
    """:func:`anti_on` for a batch whose key rows are few (their size is
    checked by the caller): ``batch_keys`` (the batch's packed keys, one per
    input row, copies included, so no shuffle is needed to build them) are
    broadcast to the known side, which is then only scanned and filtered
    instead of shuffled; the few known keys that match are removed from the
    batch.  Same result as :func:`anti_on`, since
    ``batch - known = batch - (known ∩ batch keys)``.
    """
    key_cols = list(key_cols)
    matched = known.select(*key_cols).join(F.broadcast(batch_keys.select(*key_cols)), on=key_cols, how="left_semi")
    return batch.join(matched, on=key_cols, how="left_anti")


def matched_keys(known: DataFrame, batch_keys: DataFrame, key_cols: Sequence[str] = KEY_COLS) -> DataFrame:
    """The known keys that the batch delivers again, as ``key_cols``.

    For a batch too large to be broadcast.  Written as a semi-join so that
    Spark's runtime filter can act: it builds a Bloom filter from the batch's
    keys and drops known keys that cannot match where they are scanned, before
    they are shuffled.  (Its thresholds are the session's:
    ``spark.sql.optimizer.runtime.bloomFilter.*``.)  What passes by mistake is
    dropped by the join, so the filter never changes the result.
    """
    key_cols = list(key_cols)
    # Holds for every row; a filter is what tells the optimizer that this side selects.
    asked = batch_keys.where(F.col(key_cols[0]) % 2 > -2).select(*key_cols)
    return known.select(*key_cols).join(asked, on=key_cols, how="left_semi")


def written_matches(
    known: DataFrame, batch_keys: DataFrame, width: int | None, budget: int, key_cols: Sequence[str] = KEY_COLS
) -> tuple[DataFrame, int, bool]:
    """:func:`matched_keys`, each once, written to the session's shared folder
    and counted, and whether they fit ``budget`` as a broadcast table
    (``width`` bounds the bytes of one)."""
    key_cols = list(key_cols)
    spark = known.sparkSession
    path = shared_scratch(spark, "matched-keys")
    found = matched_keys(known, batch_keys, key_cols).distinct()
    found.write.parquet(path)
    matched = spark.read.schema(found.schema).parquet(path)
    n = matched.count()  # from the file footers
    return matched, n, width is not None and n * width <= budget


def in_known_partitions(known: DataFrame, part: str, profile: BatchProfile) -> Column | None:
    """Which rows of a profiled batch lie in a partition value that ``known``
    (pruned to the batch's values) has; all others are new.  ``None``: not
    told apart, as they all may, or there are too many values."""
    dtype = known.schema[part].dataType
    if profile.values is None or not _collectable(dtype):
        return None
    n_values = len(profile.values) + profile.has_null
    met = known.select(_collected(F.col(part), dtype)).distinct().limit(n_values + 1).collect()
    if len(met) >= n_values:
        return None
    values = [_literal(v, dtype) for (v,) in met if v is not None]
    there = F.coalesce(F.col(part).isin(*values), F.lit(False)) if values else F.lit(False)
    return there | F.col(part).isNull() if len(values) < len(met) else there


def anti_join_keys(
    batch: DataFrame,
    existing_keys: DataFrame,
    part: str | None,
    keys: str | Sequence[str],
    scope: str = "partition",
    nulls: str = "safe",
    broadcast_budget: int | None = None,
) -> DataFrame:
    """Rows of ``batch`` whose ``(part, *keys)`` (or ``keys`` in global scope)
    is not in ``existing_keys``.  Payload columns are never compared.

    ``nulls="safe"`` (default) treats null as a value, so a null key already
    loaded filters a null key again.  ``nulls="sql"`` uses plain SQL equality
    (null never matches): only for keys declared non-null.

    ``broadcast_budget`` (bytes, off by default): profile the batch first and,
    when its rows times the bound of a key's width fit, broadcast the batch
    keys so ``existing_keys`` is filtered instead of shuffled (null-safe form
    only).
    """
    cols = key_columns(part, keys, scope)
    if nulls == "sql":
        return batch.join(existing_keys.select(*cols), on=cols, how="left_anti")
    if nulls != "safe":
        raise ValueError("nulls must be 'safe' or 'sql'")
    known = existing_keys.select(*packed_key(existing_keys.schema, cols))
    packed = with_packed_key(batch, cols)
    if broadcast_budget and fits(batch.schema, cols, profile_batch(batch, None, cols), broadcast_budget):
        out = anti_on_broadcast_keys(packed, known, batch.select(*packed_key(batch.schema, cols)))
    else:
        out = anti_on(packed, known)
    return out.select(*batch.columns)


def fits(schema: T.StructType, cols: Sequence[str], profile: BatchProfile, budget: int) -> bool:
    """Do all keys of a profiled batch fit ``budget`` bytes?"""
    width = key_bytes_bound(schema, cols, profile.longest)
    return width is not None and profile.n_rows * width <= budget
