"""In-batch de-duplication (one row per key tuple)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from increload.functions.keys import HASH_COL, KEY_COL, KEY_COLS, as_list, key_columns, orderable, with_packed_key
from increload.session import shared_scratch

# A hash in a broadcast relation: its row, and room around it in the hash map.
HASH_ROW_BYTES = 64
DEFAULT_HASH_BUDGET = 64 << 20


def pick_row(df: DataFrame, row_cols: Sequence[str]):
    """Aggregate choosing one whole row of ``row_cols`` per group: the
    smallest by those columns in order; columns that cannot be ordered (maps)
    ride along; with none orderable, the first row met."""
    row = F.struct(*[F.col(c) for c in row_cols])
    rank_cols = [c for c in row_cols if orderable(df.schema[c].dataType)]
    if len(rank_cols) == len(row_cols):
        return F.min(row)
    if rank_cols:
        return F.min_by(row, F.struct(*[F.col(c) for c in rank_cols]))
    return F.first(row)


def dedup_on(df: DataFrame, id_cols: Sequence[str], order_by: Sequence[str] | None = None) -> DataFrame:
    """Keep one row per packed key of ``df`` (columns ``HASH_COL``, ``KEY_COL``
    built from ``id_cols`` by :func:`with_packed_key`).

    The surviving row is the smallest by ``(*order_by, *every other column)``,
    so the choice is total and the same on every run and retry.  Without
    ``order_by`` that is simply the smallest whole row.  Columns that cannot
    be ordered (maps) ride along with the row the others choose; if no
    column can be ordered, the first row met survives.

    A grouped aggregate with a map-side partial step: a key delivered a
    million times is collapsed inside each map task before the shuffle, so a
    hot key never lands whole in one reducer (a window ``row_number`` would
    sort every copy in one task).  The identifying columns travel once, inside
    the packed key, not again in the row (a whole-text key is not shuffled
    twice).
    """
    id_cols = list(id_cols)
    columns = [c for c in df.columns if c not in KEY_COLS]
    order_by = as_list(order_by)
    missing = [c for c in order_by if c not in columns]
    if missing:
        raise ValueError(f"order_by columns not in the batch: {missing}")
    payload = [c for c in columns if c not in id_cols]
    ranked = [c for c in order_by if c not in id_cols]
    row_cols = [*ranked, *[c for c in payload if c not in ranked]]
    if not row_cols:
        out = df.select(*KEY_COLS).distinct()
    else:
        out = df.groupBy(*KEY_COLS).agg(pick_row(df, row_cols).alias("__row"))
    value = {c: F.col(KEY_COL).getField(c) for c in id_cols}
    value.update({c: F.col("__row").getField(c) for c in payload})
    return out.select(HASH_COL, KEY_COL, *[value[c].alias(c) for c in columns])


def repeated_hashes(df: DataFrame, budget: int) -> tuple[DataFrame, int] | None:
    """Key hashes that ``df`` (with a packed key) holds more than once, written
    to the session's shared folder, and how many; ``None`` when they exceed
    ``budget`` bytes as a broadcast table.

    A hash aggregate over one long per row, combined in each task: no row of
    ``df`` moves and nothing is sorted.
    """
    spark = df.sparkSession
    path = shared_scratch(spark, "repeated-keys")
    met = df.groupBy(HASH_COL).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(HASH_COL)
    met.write.parquet(path)
    repeated = spark.read.schema(met.schema).parquet(path)
    n = repeated.count()  # from the file footers
    return (repeated, n) if n * HASH_ROW_BYTES <= budget else None


def dedup_two_pass(
    df: DataFrame, id_cols: Sequence[str], order_by: Sequence[str] | None = None, budget: int = DEFAULT_HASH_BUDGET
) -> DataFrame:
    """:func:`dedup_on` for a batch in which few keys repeat.

    The first pass counts key hashes.  In the second, rows whose hash occurs
    once pass through as they are, unsorted and unmoved, and only the others
    go through the ordered choice.  Equal keys have equal hashes, so a key
    never takes both ways; a key that shares its hash with another one is
    merely chosen from one row.  When the repeated hashes are too many to be
    broadcast, every row takes the ordered choice.

    ``df`` is read twice and must give the same rows both times.
    """
    found = repeated_hashes(df, budget)
    if found is None:
        return dedup_on(df, id_cols, order_by)
    columns = [HASH_COL, KEY_COL, *[c for c in df.columns if c not in KEY_COLS]]
    repeated, n = found
    if not n:
        return df.select(*columns)
    repeated = F.broadcast(repeated)
    once = df.join(repeated, HASH_COL, "left_anti").select(*columns)
    return once.unionByName(dedup_on(df.join(repeated, HASH_COL, "left_semi"), id_cols, order_by))


def dedup_batch(
    df: DataFrame,
    part: str | None,
    keys: str | Sequence[str],
    order_by: Sequence[str] | None = None,
    scope: str = "partition",
    two_pass: bool = False,
) -> DataFrame:
    """One row per ``(part, *keys)`` (``scope="partition"``) or per ``keys``
    (``scope="global"``); the batch's schema is kept unchanged.

    Null keys and null partition values are ordinary values: two rows with a
    null key in the same partition are duplicates of each other.  The result
    does not depend on how the input is partitioned.  ``two_pass`` counts the
    keys first and sorts only rows of keys met twice (:func:`dedup_two_pass`).
    """
    cols = key_columns(part, keys, scope)
    packed = with_packed_key(df, cols)
    out = dedup_two_pass(packed, cols, order_by) if two_pass else dedup_on(packed, cols, order_by)
    return out.select(*df.columns)
