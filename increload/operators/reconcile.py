"""Does a stored key index hold exactly the keys of its master table?

An index can be committed and wrong: written from other rows, appended twice,
damaged by hand.  Loads trust it.  Comparing all keys would shuffle both
tables whole; instead, additive fingerprints are compared from the top down,
and keys are read only where they differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from increload.functions.keys import HASH_COL, KEY_COL, KEY_COLS, binary_equal, key_columns, with_packed_key
from increload.operators.antijoin import profile_batch, prune_to_profile
from increload.session import shared_scratch

PREFIX_BITS = 10


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = shared_scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _code(schema: T.StructType, cols: Sequence[str]) -> Column:
    """A hash of the key that counts nulls too.  ``xxhash64`` passes over them,
    so keys like (1, null) and (null, 1) have one ``HASH_COL``; likewise nulls
    and borders within nested values."""
    nested = [c for c in cols if isinstance(schema[c].dataType, (T.ArrayType, T.StructType)) and binary_equal(schema[c].dataType)]
    shapes = [F.to_json(F.struct(c), {"ignoreNullFields": "false"}) for c in nested]
    return F.xxhash64(HASH_COL, *[F.col(c).isNull() for c in cols], *shapes)


def _fingerprint(code: Column) -> list[Column]:
    """Count, sum and exclusive or of the key hashes: equal for equal multisets
    in any order, and combined by adding, so each task sends one row a group."""
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(code.cast("decimal(38,0)")).alias("s"),
        F.bit_xor(code).alias("x"),
    ]


def fingerprints(keys_df: DataFrame, part: str | None, cols: Sequence[str], prefix_bits: int = 0) -> DataFrame:
    """``(group, n, s, x)`` of a key table, where ``group`` is a struct of the
    partition value and the first ``prefix_bits`` bits of the key's hash."""
    packed = with_packed_key(keys_df.select(*cols), cols)
    return packed.groupBy(_group(part, prefix_bits).alias("group")).agg(*_fingerprint(_code(packed.schema, cols)))


def _group(part: str | None, prefix_bits: int) -> Column:
    prefix = F.shiftrightunsigned(HASH_COL, 64 - prefix_bits).cast("int") if prefix_bits else F.lit(0)
    place = F.col(part) if part is not None else F.lit(None).cast("int")
    return F.struct(place.alias("part"), prefix.alias("prefix"))


def differing_groups(index: DataFrame, master: DataFrame, part: str | None, cols: Sequence[str], prefix_bits: int = 0) -> DataFrame:
    """``group`` of :func:`fingerprints` in which the two tables differ."""
    signed = [fingerprints(index, part, cols, prefix_bits).withColumn("sign", F.lit(1)), fingerprints(master, part, cols, prefix_bits).withColumn("sign", F.lit(-1))]
    both = signed[0].unionByName(signed[1]).groupBy("group").agg(
        F.sum(F.col("n") * F.col("sign")).alias("n"), F.sum(F.col("s") * F.col("sign")).alias("s"), F.bit_xor("x").alias("x")
    )
    return both.where("n != 0 or s != 0 or x != 0").select("group")


def reconcile_index(
    index: DataFrame, master: DataFrame, part: str | None, keys: str | Sequence[str], scope: str = "partition", prefix_bits: int = PREFIX_BITS
) -> DataFrame:
    """Keys on which ``index`` and ``master`` disagree, one row each:
    ``(part, *keys, n_master, n_index, finding)``, ``finding`` being

    * ``lost``: in the master, not in the index (would be loaded again);
    * ``foreign``: in the index, not in the master (would never be loaded);
    * ``doubled``: in both, more often in the index;
    * ``repeated``: in both, more often in the master.

    A key that is equally often in both is no disagreement.

    1. Fingerprints per partition value: one scan of the keys of each table, a
       row per task and value is moved.  Equal tables end here.
    2. In the partitions that differ (only these are read again): fingerprints
       per prefix of the key hash.
    3. In the prefixes that differ: the keys themselves, counted on both sides.

    Equal fingerprints of different key sets would need count, sum and
    exclusive or of their 64-bit hashes to agree by chance.  Keys are compared
    with nulls equal.
    """
    cols = key_columns(part, keys, scope)
    own_part = part if part in cols else None
    names = list(dict.fromkeys(cols))
    index, master = index.select(*names), master.select(*names)
    if own_part is not None:
        places = _staged(differing_groups(index, master, own_part, cols).select(F.col("group.part").alias(own_part)), "reconcile-parts")
        profile = profile_batch(places, own_part, [own_part])
        index, master = (prune_to_profile(df, own_part, profile) for df in (index, master))
    groups = _staged(differing_groups(index, master, own_part, cols, prefix_bits), "reconcile-groups")

    def asked(df: DataFrame, side: str) -> DataFrame:
        rows = with_packed_key(df, cols).withColumn("group", _group(own_part, prefix_bits))
        return rows.join(groups, "group", "left_semi").select(*KEY_COLS, F.lit(int(side == "master")).alias("m"), F.lit(int(side == "index")).alias("i"))

    counted = asked(master, "master").unionByName(asked(index, "index")).groupBy(*KEY_COLS).agg(F.sum("m").alias("n_master"), F.sum("i").alias("n_index"))
    finding = (
        F.when(F.col("n_index") == 0, "lost").when(F.col("n_master") == 0, "foreign")
        .when(F.col("n_index") > F.col("n_master"), "doubled").when(F.col("n_master") > F.col("n_index"), "repeated")
    )
    told = counted.withColumn("finding", finding).where("finding is not null")
    return told.select(*[F.col(KEY_COL).getField(c).alias(c) for c in names], "n_master", "n_index", "finding")


def corrected_index(index: DataFrame, findings: DataFrame) -> DataFrame:
    """``index`` with the findings mended: lost keys added, foreign ones
    dropped, doubled ones held once."""
    names = index.columns
    wrong = findings.where("finding in ('foreign', 'doubled')").select(*names)
    right = findings.where("finding in ('lost', 'doubled')").select(*names)
    packed = with_packed_key(index, names)
    kept = packed.join(with_packed_key(wrong, names).select(*KEY_COLS), on=KEY_COLS, how="left_anti").select(*names)
    return kept.unionByName(right)
