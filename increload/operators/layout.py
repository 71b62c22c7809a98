"""Partition sizing and bucket layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from increload.functions.keys import DATE_PATTERN, bucket_of, date_token


def with_bucket(df: DataFrame, col: str, n: int, name: str = "bucket") -> DataFrame:
    """Add ``name = pmod(col, n)`` (int; null -> 0; fractional truncated).

    Consecutive integers (dates as ``yyyyMMdd``, years) land in different
    buckets, which a hash would not guarantee.
    """
    return df.withColumn(name, bucket_of(F.col(col), df.schema[col].dataType, n))


def layout_by_bucket(
    df: DataFrame, col: str, n: int, spread: int | None = None, rows_per_partition: int = 1_000_000
) -> DataFrame:
    """Place rows so that Spark partitions ``[b*spread, (b+1)*spread)`` hold
    exactly the rows of bucket ``b``.

    Each bucket is split over ``spread`` partitions by a hash of the whole
    row.  By default ``spread`` comes from the largest bucket (one count per
    bucket): as many partitions as it needs for ``rows_per_partition`` rows
    each, however hot it is.  ``spread=1`` gives one partition per bucket.
    """
    bucket = bucket_of(F.col(col), df.schema[col].dataType, n)
    if spread is None:
        largest = df.groupBy(bucket.alias("b")).count().agg(F.max("count")).first()[0] or 0
        spread = max(1, -(-largest // rows_per_partition))
    if spread < 1:
        raise ValueError("spread must be >= 1")
    if spread == 1:
        pid = bucket
    else:
        pid = bucket * spread + F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(spread)).cast("int")
    return df.repartitionById(n * spread, pid)


def bucket_profile(df: DataFrame, bucket_col: str = "bucket") -> DataFrame:
    """Rows per bucket: ``(bucket, n_rows)``."""
    return df.groupBy(bucket_col).agg(F.count(F.lit(1)).alias("n_rows"))


def first_segment(paths: DataFrame, base: str | None = None, path_col: str = "path") -> DataFrame:
    """The path segment directly below ``base`` (file or ``k=v`` directory name).

    Without ``base`` the whole path is kept.
    """
    if base is None:
        return paths.select(F.col(path_col).alias("segment"))
    prefix = base.rstrip("/") + "/"
    rel = F.when(F.col(path_col).startswith(prefix), F.substring(F.col(path_col), len(prefix) + 1, 1 << 30))
    return paths.select(F.substring_index(F.coalesce(rel, F.col(path_col)), "/", 1).alias("segment"))


def estimate_partitions_by_date(
    paths: DataFrame, pattern: str = DATE_PATTERN, base: str | None = None, path_col: str = "path"
) -> DataFrame:
    """One row ``estimate``: distinct dates found in the input names.

    Names without a date all count together as one more value.
    """
    seg = first_segment(paths, base, path_col)
    return seg.select(date_token(F.col("segment"), pattern).alias("token")).agg(
        F.count_distinct("token").alias("estimate")
    )


def require_partitions(estimate: DataFrame) -> int:
    """The estimate as an int; an input location that estimates to no
    partition at all (no input file) raises ``ValueError``."""
    n = estimate.first()["estimate"]
    if not n:
        raise ValueError("the batch location holds no input file")
    return int(n)


def estimate_partitions_by_files(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """One row ``estimate``: number of distinct input files."""
    return paths.agg(F.count_distinct(path_col).alias("estimate"))


def estimate_partitions_by_bytes(listing: DataFrame, target_bytes: int = 128 << 20, growth: float = 1.0) -> DataFrame:
    """One row ``estimate``: partitions of ``target_bytes`` that the listed
    files fill, ``growth`` times as large once loaded (compressed or text files
    are not what Parquet makes of them).  0 if there is no file at all."""
    size = F.ceil(F.sum("length") * F.lit(float(growth)) / F.lit(float(target_bytes)))
    return estimate_partitions(listing, F.when(F.count(F.lit(1)) > 0, F.greatest(size, F.lit(1))).otherwise(F.lit(0)))


def estimate_partitions(listing: DataFrame, estimator: Column) -> DataFrame:
    """One row ``estimate`` by a rule of the user's own: an aggregate over the
    columns of :func:`increload.sources.files.list_input_files` (``path``,
    ``segment``, ``length``), as in
    ``F.count_distinct(date_token(F.col("segment")))``."""
    return listing.agg(F.coalesce(estimator.cast("long"), F.lit(0).cast("long")).alias("estimate"))


def spread_for_write(df: DataFrame, part: str, keys: Sequence[str], n: int, counts: Sequence[tuple[Column | None, int]]) -> DataFrame:
    """``df`` dealt to exactly ``n`` partitions before it is written by ``part``.

    ``counts`` tells, for each partition value (as a literal; ``None`` for
    null), about how many rows it has.  The values are laid one after another
    over the ``n`` partitions, each as long as its share of rows: a hot value
    is split over many, by a hash of the keys, and small ones share one.  So
    tasks are even and a value comes in as few files as its size needs.
    """
    total = max(1, sum(c for _, c in counts))
    spark, before, rows = df.sparkSession, 0, []
    for value, c in counts:
        first, last = before * n // total, max(before * n // total, (before + c) * n // total - 1)
        before += c
        rows.append((value, first, last - first + 1))
    dtype = df.schema[part].dataType
    shares = F.array(*[
        F.struct((v if v is not None else F.lit(None)).cast(dtype).alias("value"), F.lit(a).alias("first"), F.lit(w).alias("width"))
        for v, a, w in rows
    ])
    table = spark.range(0, 1, 1, 1).select(F.explode(shares).alias("s")).select(
        F.col("s.value").alias("__value"), F.col("s.first").alias("__first"), F.col("s.width").alias("__width")
    )
    # One row per partition value of a profiled batch: bounded by the profile.
    met = df.join(F.broadcast(table), F.col(part).eqNullSafe(F.col("__value")), "left")
    hashed = F.xxhash64(*[F.col(k) for k in keys])
    slot = F.coalesce(F.col("__first") + F.pmod(hashed, F.col("__width")), F.pmod(hashed, F.lit(n)))
    return met.withColumn("__slot", F.pmod(slot, F.lit(n)).cast("int")).repartitionById(n, F.col("__slot")).drop("__value", "__first", "__width", "__slot")
