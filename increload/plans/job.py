"""The load job against stored tables: delta first, then index, each committed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from increload.functions.keys import as_list, key_columns
from increload.operators.antijoin import DEFAULT_BROADCAST_BUDGET, DEFAULT_MAX_PRUNE_VALUES, fits, profile_batch
from increload.operators.audit import payload_hash
from increload.operators.layout import require_partitions, spread_for_write
from increload.plans.load import Tally, new_rows
from increload.session import shared_scratch
from increload.sources import tables

# Ids from here on belong to streams (see increload.streaming.micro_batch).
STREAM_IDS = 1 << 52


@dataclass(frozen=True)
class LoadReport:
    """What a stored load did: rows appended, whether nothing was loaded
    before, which earlier batches had their keys read from master because
    their index was missing, and whether the batch's rows were committed
    already, so that nothing was appended now.

    Where the batch's rows went: ``n_input = n_copies + n_known + n_rows``, of
    which ``n_null_keys`` have a null among their key columns.  ``n_copies``
    are rows given up to another one of their key within the batch, and
    ``n_known`` keys that were loaded before.  (``None`` for a batch that was
    committed already.)
    """

    batch_id: int
    n_rows: int
    first_load: bool
    rebuilt_batches: tuple[int, ...]
    repeated: bool = False
    n_input: int | None = None
    n_null_keys: int | None = None
    n_copies: int | None = None
    n_known: int | None = None


def run_load_job(
    spark: SparkSession,
    batch: DataFrame,
    base: str,
    batch_id: int,
    part: str | None,
    keys: str | Sequence[str],
    order_by: Sequence[str] | None = None,
    scope: str = "partition",
    max_prune_values: int = DEFAULT_MAX_PRUNE_VALUES,
    broadcast_budget: int = DEFAULT_BROADCAST_BUDGET,
    estimate: DataFrame | None = None,
    land: bool = True,
) -> LoadReport:
    """Load ``batch`` as batch ``batch_id`` into the tables under ``base``.

    1. The batch is landed: written once to the session's shared folder, so
       that the steps below see the same rows whatever the source does.
       (``land=False`` for a source known to be stable, such as files.)
    2. Known keys = stored index of committed batches, plus the keys of
       committed batches whose index is missing, read from their master files.
    3. Delta = de-duplicated batch minus known keys -> an attempt directory of
       its own under ``master/batch_id=K``, then the ``data`` commit, which
       names the attempt.
    4. The delta's keys, read back from what was written -> an attempt under
       ``index/batch_id=K``, then the ``index`` commit.

    A commit is final.  When ``data`` is committed for ``batch_id``, its rows
    are never written again: a retry only finishes the index, and a different
    batch under the same id raises ``ValueError`` (told apart by row count and
    checksums of the keys and of whole rows).

    ``estimate`` (one row, from the partition estimators over the batch's
    location) is the number of partitions in which the delta is written, each
    partition value taking its share of them; an estimate of 0 raises.  Without
    one, Spark sizes the write at run time.  An empty-string partition value
    raises: partition directories cannot tell it from null.
    """
    if not 0 <= batch_id < STREAM_IDS:
        raise ValueError(f"batch ids of load jobs lie in [0, {STREAM_IDS}); ids above belong to streams")
    return load_batch(
        spark, batch, base, batch_id, part, keys, order_by, scope, max_prune_values, broadcast_budget, estimate, land
    )


def load_batch(
    spark: SparkSession,
    batch: DataFrame,
    base: str,
    batch_id: int,
    part: str | None,
    keys: str | Sequence[str],
    order_by: Sequence[str] | None,
    scope: str,
    max_prune_values: int = DEFAULT_MAX_PRUNE_VALUES,
    broadcast_budget: int = DEFAULT_BROADCAST_BUDGET,
    estimate: DataFrame | None = None,
    land: bool = True,
) -> LoadReport:
    """:func:`run_load_job` for any batch id, a stream's too."""
    keys = as_list(keys)
    reserved = [c for c in batch.columns if c in (tables.BATCH_COL, tables.ATTEMPT_COL) or c.startswith("__increload")]
    if reserved:
        raise ValueError(f"batch columns {reserved} clash with the stored table's own columns; rename them")
    partitions = require_partitions(estimate) if estimate is not None else None
    cols = key_columns(part, keys, scope)
    seen = Observation()
    whole = _content(batch, keys)
    if land:
        path = shared_scratch(spark, "landed")
        batch.observe(seen, *whole).write.parquet(path)
        batch = spark.read.schema(batch.schema).parquet(path)
        content = seen.get
    else:
        content = batch.agg(*whole).first().asDict()
    profile = profile_batch(batch, part, cols, max_prune_values)
    tag = f"{profile.tag}-{(content['x'] or 0) & (1 << 64) - 1:016x}{int(content['s'] or 0) & (1 << 64) - 1:016x}"
    if part is not None and isinstance(batch.schema[part].dataType, T.StringType):
        values = batch if profile.values is None else spark.range(1).select(F.explode(F.array(*profile.values, F.lit(None).cast("string"))).alias(part))
        if not values.where(F.col(part) == "").isEmpty():
            raise ValueError(f"an empty string in {part!r} cannot be stored as a partition value; use null or another value")
    state = tables.read_state(spark, base, batch_id)
    key_schema = tables.key_schema_of(batch.schema, part, keys)

    done = state.asked
    if done is not None:
        # tags of earlier versions tell the keys only
        if done.tag is not None and done.tag != tag and not (done.tag.count("-") == 1 and done.tag == profile.tag):
            raise ValueError(f"batch {batch_id} is already committed with other input ({done.tag}, now {tag})")
        attempt, n = done.data, done.n
        went: dict = {}
    else:
        known = tables.existing_keys(spark, base, key_schema, state)
        tally = Tally()
        large = not (broadcast_budget > 0 and fits(batch.schema, cols, profile, broadcast_budget))
        delta = new_rows(
            batch, known, part, keys, order_by, scope, True, max_prune_values, broadcast_budget, profile, two_pass=large, tally=tally
        )
        placed = partitions is not None and (part is None or profile.counts is not None)
        if placed:
            delta = spread_for_write(delta, part, cols, partitions, profile.counts) if part is not None else delta.repartition(partitions, *cols)
        attempt = tables.new_attempt()
        tables.append_delta(delta, base, batch_id, part, attempt, tally.at_write, placed)
        n = tally.appended.get.get("n")
        if n is None:  # nothing reached the write
            n = tables.read_attempt(spark, base, batch_id, attempt, batch.schema).count()
        tables.write_commit(spark, base, "data", batch_id, n, attempt, tag, state.gen)
        went = _accounts(int(content["n"]), int(content["nulls"]), n, tally)
    if done is None or not done.has_index:
        if attempt is not None:
            rows = tables.read_attempt(spark, base, batch_id, attempt, batch.schema)
        else:  # the data lies in a segment by now
            rows = tables.read_master(spark, base, batch.schema, [batch_id])
        index_attempt = tables.new_attempt()
        tables.write_key_index(rows.select(*key_schema.fieldNames()), base, batch_id, part, index_attempt)
        tables.write_commit(spark, base, "index", batch_id, n, index_attempt, None, state.gen)
    return LoadReport(int(batch_id), int(n), not state.loaded, state.missing, done is not None, **went)


def _content(batch: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Rows, rows with a null key column, and a checksum of whole rows."""
    row = payload_hash(batch.schema, batch.columns)
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return [
        F.count(F.lit(1)).alias("n"), F.count_if(null).alias("nulls"),
        F.bit_xor(row).alias("x"), F.sum(row.cast("decimal(38,0)")).alias("s"),
    ]


def _accounts(n_input: int, n_nulls: int, n_rows: int, tally: Tally) -> dict:
    if tally.known is not None:
        n_known = tally.known
    else:
        n_known = tally.distinct.get.get("n", n_rows) - n_rows
    return {"n_input": n_input, "n_null_keys": n_nulls, "n_copies": n_input - n_known - n_rows, "n_known": n_known}
