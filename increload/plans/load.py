"""The incremental de-duplicating load (in-memory form: DataFrames in, DataFrames out)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from increload.functions.keys import KEY_COLS, as_list, key_columns, packed_key, with_packed_key
from increload.operators.antijoin import (
    DEFAULT_BROADCAST_BUDGET,
    DEFAULT_MAX_PRUNE_VALUES,
    BatchProfile,
    anti_on,
    anti_on_broadcast_keys,
    fits,
    in_known_partitions,
    key_bytes_bound,
    profile_batch,
    prune_to_profile,
    written_matches,
)
from increload.operators.dedup import dedup_on, dedup_two_pass
from increload.operators.keyindex import select_keys
from increload.operators.layout import require_partitions
from increload.sources.key_table import ZONE_KEYS, KeyTable


@dataclass(frozen=True)
class LoadResult:
    """``delta``: the rows to append (batch schema).  ``index``: the key index
    ``(part, *keys)`` valid after appending the delta."""

    delta: DataFrame
    index: DataFrame


class Tally:
    """Counts that a load takes while it runs, without a scan of their own:
    rows that are left after the in-batch dedup, and those that are appended
    (Spark's observations, filled in by the job that writes the delta), and
    known keys that the batch delivered again, where they are counted first."""

    def __init__(self) -> None:
        self.distinct: Observation | None = None
        self.appended: Observation | None = None
        self.known: int | None = None

    def after_dedup(self, df: DataFrame) -> DataFrame:
        self.distinct = Observation()
        return df.observe(self.distinct, F.count(F.lit(1)).alias("n"))

    def at_write(self, df: DataFrame) -> DataFrame:
        self.appended = Observation()
        return df.observe(self.appended, F.count(F.lit(1)).alias("n"))


def _is_empty(df: DataFrame | None) -> bool:
    return df is None or df.isEmpty()


def new_rows(
    batch: DataFrame,
    known_keys: DataFrame | KeyTable | None,
    part: str | None,
    keys: str | Sequence[str],
    order_by: Sequence[str] | None = None,
    scope: str = "partition",
    prune: bool = True,
    max_prune_values: int = DEFAULT_MAX_PRUNE_VALUES,
    broadcast_budget: int = DEFAULT_BROADCAST_BUDGET,
    profile: BatchProfile | None = None,
    two_pass: bool = False,
    tally: Tally | None = None,
) -> DataFrame:
    """De-duplicate ``batch`` and drop the keys in ``known_keys`` (``None``: nothing known).

    One logical plan: the dedup and the anti-join group/join on the same
    packed key, so the batch is shuffled once.  Before planning, one small
    job profiles the batch (partition values, row count, key widths; or
    ``profile`` is a profile made earlier):

    * partition scope: the known keys are pruned to the batch's partition
      values (a filter on the scan, or pruning at run time for very many);
    * when the row count times the bound of a key's width fits
      ``broadcast_budget`` (a bound on the batch's key set, checked before
      anything is broadcast), the batch keys are broadcast to the known side
      instead of shuffling the known side; otherwise both sides meet in a
      sort-merge join, which AQE may still turn into a broadcast of the
      known side at run time.  ``broadcast_budget=0`` disables it.
    * a :class:`KeyTable` as known side is joined bucket by bucket: only the
      batch moves;
    * ``two_pass``, for a batch over the budget that gives the same rows each
      time it is read: keys alone are counted and matched first (with Spark's
      Bloom filter on the known side), and whole rows then pass without
      being sorted, but for those of keys met twice.  Rows in partition
      values without known keys are new and take no part in the match.  When
      the matches exceed the budget, rows of the other partition values are
      shuffled, once.

    ``tally`` gets the counts of the load once its result is written.
    """
    cols = key_columns(part, keys, scope)
    counted = tally.after_dedup if tally is not None else lambda df: df
    table = known_keys if isinstance(known_keys, KeyTable) else None
    if table is not None and (table.columns != cols or table.part != part):
        raise ValueError(f"the key table is keyed by {table.columns}, not {cols}")
    packed = table.packed(batch) if table is not None else with_packed_key(batch, cols)
    if known_keys is None:
        deduped = dedup_two_pass(packed, cols, order_by) if two_pass else dedup_on(packed, cols, order_by)
        return counted(deduped).select(*batch.columns)
    known = table.rows() if table is not None else known_keys
    pruning = scope == "partition" and part is not None and prune
    broadcasting = broadcast_budget > 0 and key_bytes_bound(batch.schema, cols) is not None
    if profile is None and (pruning or broadcasting):
        profile = profile_batch(batch, part if pruning else None, cols, max_prune_values)
    if pruning:
        known = prune_to_profile(known, part, profile, broadcast_budget)
    if table is not None and profile is not None and profile.n_rows <= ZONE_KEYS:
        known = table.near(known, packed)
    pruned = known
    known = known.select(*KEY_COLS) if table is not None else known.select(*packed_key(known.schema, cols))
    if broadcasting and fits(batch.schema, cols, profile, broadcast_budget):
        deduped = anti_on_broadcast_keys(counted(dedup_on(packed, cols, order_by)), known, packed.select(*KEY_COLS))
    elif two_pass:
        met = in_known_partitions(pruned, part, profile) if pruning else None
        asked = packed if met is None else packed.where(met)
        width = key_bytes_bound(batch.schema, cols, profile.longest) if profile is not None else None
        matched, n, small = written_matches(known, asked.select(*KEY_COLS), width, broadcast_budget or DEFAULT_BROADCAST_BUDGET)
        if tally is not None:
            tally.known = n
        if small:
            new = packed.join(F.broadcast(matched), on=KEY_COLS, how="left_anti")
            deduped = dedup_two_pass(new, cols, order_by)
        else:  # rows that may be known move once; equal keys lie in one partition value
            deduped = anti_on(dedup_on(asked, cols, order_by), matched)
            if met is not None:
                deduped = deduped.unionByName(dedup_two_pass(packed.where(~met), cols, order_by))
    else:
        deduped = anti_on(counted(dedup_on(packed, cols, order_by)), known)
    return deduped.select(*batch.columns)


def incremental_load(
    batch: DataFrame,
    existing: DataFrame | None = None,
    index: DataFrame | KeyTable | None = None,
    part: str | None = None,
    keys: str | Sequence[str] = (),
    order_by: Sequence[str] | None = None,
    scope: str = "partition",
    prune: bool = True,
    max_prune_values: int = DEFAULT_MAX_PRUNE_VALUES,
    broadcast_budget: int = DEFAULT_BROADCAST_BUDGET,
    estimate: DataFrame | None = None,
    two_pass: bool = False,
) -> LoadResult:
    """Which rows of ``batch`` must be appended to ``existing``?

    * ``existing`` is ``None`` or empty: first load.  The batch is only
      de-duplicated and any ``index`` is ignored.
    * ``index`` given: the batch is filtered against it.  A :class:`KeyTable`
      is joined without being shuffled; append ``delta`` to it once that is
      written.
    * ``index`` is ``None``: the keys are read from ``existing`` (column- and
      partition-pruned scan) instead.

    ``scope="partition"`` matches on ``(part, *keys)``; ``"global"`` on the
    keys alone, across partitions.  Insert-only: a known key with a changed
    payload is dropped, never updated.

    ``estimate`` (one row, from the partition estimators over the batch's
    location) guards against an empty location: an estimate of 0 raises.
    ``two_pass``: see :func:`new_rows`.

    The plan reads ``batch`` more than once (profile, keys, rows), and the
    result is lazy: ``batch`` must give the same rows each time.  For a source
    that changes, or that is dear to read, write it to a table first, as
    :func:`increload.plans.job.run_load_job` does.
    """
    keys = as_list(keys)
    if estimate is not None:
        require_partitions(estimate)
    if _is_empty(existing):
        delta = new_rows(batch, None, part, keys, order_by, scope, two_pass=two_pass)
        return LoadResult(delta, select_keys(delta, part, keys))
    if isinstance(index, KeyTable):
        delta = new_rows(batch, index, part, keys, order_by, scope, prune, max_prune_values, broadcast_budget, two_pass=two_pass)
        return LoadResult(delta, index.index().unionByName(select_keys(delta, part, keys)))
    known = index if index is not None else select_keys(existing, part, keys)
    known = known.select(*select_keys(known, part, keys).columns)
    delta = new_rows(batch, known, part, keys, order_by, scope, prune, max_prune_values, broadcast_budget, two_pass=two_pass)
    # The delta's keys are disjoint from the known keys by construction, so
    # the merged index is a plain union (no distinct, no shuffle).  A rebuilt
    # index is de-duplicated once.
    base_index = known if index is not None else known.distinct()
    return LoadResult(delta, base_index.unionByName(select_keys(delta, part, keys)))
