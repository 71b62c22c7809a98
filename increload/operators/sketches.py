"""Mergeable sketches of keys: sizes and overlaps without scanning the index.

A theta sketch per batch and partition value stands for its set of keys in at
most ``8 * 2**lg`` bytes.  Kept beside each batch, sketches of many batches
merge by aggregation, and the overlap of a new batch with everything loaded is
read off two sketches.  Below ``2**lg`` keys a sketch is exact; above, its
relative error is about ``1 / sqrt(2**lg)`` (of the union, for overlaps).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from increload.functions.keys import HASH_COL, key_columns, with_packed_key

LG = 14


def relative_error(lg: int = LG) -> float:
    """One standard error of a count, as a share of it."""
    return 2 ** (-lg / 2)


def sketch_keys(df: DataFrame, part: str | None, keys: str | Sequence[str], scope: str = "partition", lg: int = LG) -> DataFrame:
    """``(part, n_rows, sketch)`` of a batch, a master or an index, one row per
    partition value (one row in all when ``part`` is ``None``).  One scan; each
    task sends one sketch per value."""
    cols = key_columns(part, keys, scope)
    packed = with_packed_key(df.select(*dict.fromkeys([*([part] if part is not None else []), *cols])), cols)
    stats = [F.count(F.lit(1)).alias("n_rows"), F.theta_sketch_agg(HASH_COL, lg).alias("sketch")]
    return packed.groupBy(*_by(part)).agg(*stats)


def _by(part: str | None) -> list[str]:
    return [part] if part is not None else []


def merge_sketches(sketches: DataFrame, part: str | None, lg: int = LG) -> DataFrame:
    """Sketches of many batches as one per partition value."""
    return sketches.groupBy(*_by(part)).agg(F.sum("n_rows").alias("n_rows"), F.theta_union_agg("sketch", lg).alias("sketch"))


def _count(sketch: Column) -> Column:
    return F.round(F.theta_sketch_estimate(sketch)).cast("long")


def key_counts(sketches: DataFrame, part: str | None) -> DataFrame:
    """``(part, n_rows, n_keys)``: rows, and about how many different keys."""
    return sketches.select(*_by(part), "n_rows", _count(F.col("sketch")).alias("n_keys"))


def size_quantiles(sketches: DataFrame, ranks: Sequence[float] = (0.0, 0.5, 0.9, 1.0)) -> DataFrame:
    """``(rank, n_keys)``: quantiles of the partitions' numbers of keys, by a
    quantile sketch that tasks merge; the size of the table does not matter."""
    one = sketches.agg(F.kll_sketch_agg_bigint(_count(F.col("sketch"))).alias("q"))
    read = [F.struct(F.lit(float(r)).alias("rank"), F.kll_sketch_get_quantile_bigint("q", F.lit(float(r))).alias("n_keys")) for r in ranks]
    return one.select(F.explode(F.array(*read)).alias("s")).select("s.rank", "s.n_keys")


def forecast_load(batch: DataFrame, loaded: DataFrame, part: str | None) -> DataFrame:
    """What a load will do, from sketches alone, per partition value of the batch:
    ``(part, n_rows, n_keys, n_known, n_new)``: rows, about how many different
    keys, how many of these are loaded already, and how many will be appended.
    """
    place = F.col(part) if part is not None else F.lit(0)
    there = loaded.select(place.alias("__there"), F.col("sketch").alias("__loaded"))
    met = batch.withColumn("__here", place).join(there, F.col("__here").eqNullSafe(F.col("__there")), "left")
    none = F.col("__loaded").isNull()
    known = F.when(none, F.lit(0).cast("long")).otherwise(_count(F.theta_intersection("sketch", "__loaded")))
    new = F.when(none, _count(F.col("sketch"))).otherwise(_count(F.theta_difference("sketch", "__loaded")))
    return met.select(*_by(part), "n_rows", _count(F.col("sketch")).alias("n_keys"), known.alias("n_known"), new.alias("n_new"))
