"""Column expressions shared by the operators.

Everything here returns a ``pyspark.sql.Column`` so that it stays inside
Catalyst and whole-stage codegen; nothing runs per row in Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of the internal packed-key columns.  They never leave an operator.
HASH_COL = "__increload_hash"
KEY_COL = "__increload_key"
KEY_COLS = [HASH_COL, KEY_COL]

# Fixed value: the default pattern for an 8-digit date in a file name.
# Greedy prefix, so the *last* run of eight digits wins.
DATE_PATTERN = r"^.*(\d{8}).*$"


def as_list(cols: str | Sequence[str] | None) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def key_columns(part: str | None, keys: str | Sequence[str], scope: str = "partition") -> list[str]:
    """The columns that identify a row: (part, *keys), or keys alone in global scope."""
    keys = as_list(keys)
    if not keys:
        raise ValueError("at least one primary key column is required")
    if scope not in ("partition", "global"):
        raise ValueError(f"scope must be 'partition' or 'global', not {scope!r}")
    if scope == "partition" and part is not None:
        return list(dict.fromkeys([part, *keys]))
    return list(dict.fromkeys(keys))


def binary_equal(dtype: T.DataType) -> bool:
    """Are equal values of this type equal in bytes?  Not so for strings with
    a collation other than the binary one."""
    if isinstance(dtype, T.StringType):
        return getattr(dtype, "collation", "UTF8_BINARY") == "UTF8_BINARY"
    if isinstance(dtype, T.ArrayType):
        return binary_equal(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(binary_equal(f.dataType) for f in dtype.fields)
    return True


def packed_key(schema: T.StructType, cols: Sequence[str]) -> list[Column]:
    """``[xxhash64(cols), struct(cols)]``: the identifying columns packed.

    The struct is never null and Spark compares structs field by field with
    nulls equal, so grouping and equi-joining on it is null-safe; a dedup and
    an anti-join on the pair hash the same expressions, so the join reuses the
    dedup's exchange instead of shuffling the batch a second time
    (``eqNullSafe`` hashes on ``coalesce``/``isnull`` terms, which no
    aggregate produces).  The leading 64-bit hash gives the sort-based
    aggregate and the sort-merge join a sort prefix: a struct alone has none,
    which made every comparison walk the struct (about 2x slower).  Only
    columns whose equal values are equal in bytes are hashed: strings that a
    collation makes equal differ in ``xxhash64`` and are left to the struct.
    So equal structs have equal hashes, and the hash never changes a match.
    """
    fields = [F.col(c) for c in cols]
    hashed = [F.col(c) for c in cols if binary_equal(schema[c].dataType)]
    code = F.xxhash64(*hashed) if hashed else F.lit(0).cast("long")
    return [code.alias(HASH_COL), F.struct(*fields).alias(KEY_COL)]


def with_packed_key(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    h, k = packed_key(df.schema, cols)
    return df.withColumns({HASH_COL: h, KEY_COL: k})


def orderable(dtype: T.DataType) -> bool:
    """Can Spark compare values of this type (needed by ``min``)?"""
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return False
    if isinstance(dtype, T.ArrayType):
        return orderable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(orderable(f.dataType) for f in dtype.fields)
    return True


def all_null(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.isNull() for c in cols])


def yyyymmdd(ts: str | Column) -> Column:
    """``yyyyMMdd`` of a date/timestamp as an int, computed arithmetically."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def bucket_of(c: Column, dtype: T.DataType, n: int) -> Column:
    """Non-negative ``value mod n`` as an int; null goes to bucket 0.

    Fractional values are truncated toward zero first; those that no long can
    hold (NaN, infinite, too large) count as null.  Non-numeric types are
    rejected, as a bucket must be computable without hashing.
    """
    if n <= 0:
        raise ValueError("number of buckets must be positive")
    if isinstance(dtype, _INTEGRAL):
        v = c
    elif isinstance(dtype, _FRACTIONAL):
        v = c.try_cast("long")
    else:
        raise TypeError(f"bucket column must be numeric, got {dtype.simpleString()}")
    return F.coalesce(F.pmod(v, F.lit(n)), F.lit(0)).cast("int")


def date_token(path: Column, pattern: str = DATE_PATTERN) -> Column:
    """First capture group of ``pattern`` in ``path``; ``""`` when it does not match."""
    return F.regexp_extract(path, pattern, 1)
