"""The index-free baseline: match the batch against master keys with a join.

Semantics of the baseline kept on purpose (they differ from
:func:`increload.plans.load.incremental_load`):

* keys are matched on the key columns alone, not on the partition value;
* master is first restricted to the partition values the batch touches;
* a batch row whose key is entirely null is always kept (an outer join's
  "right side is null" test cannot tell a null match from no match);
* survivors are grouped on ``(keys, part)``: ``output="counts"`` counts the
  non-null values of each value column, ``output="one"`` keeps one whole row
  per group (the smallest, so the choice is repeatable).

The outer-join-plus-null-test is written as the equivalent left-anti join
against master keys that are not all null, which Spark plans without
materialising matched pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from increload.functions.keys import all_null, as_list, orderable, packed_key, with_packed_key
from increload.operators.antijoin import DEFAULT_MAX_PRUNE_VALUES, anti_on, prune_to_batch_partitions
from increload.operators.dedup import pick_row


def sql_dedup(
    batch: DataFrame,
    existing: DataFrame,
    part: str,
    keys: str | Sequence[str],
    value_cols: Sequence[str] | None = None,
    output: str = "counts",
    max_prune_values: int = DEFAULT_MAX_PRUNE_VALUES,
) -> DataFrame:
    keys = as_list(keys)
    master_keys = prune_to_batch_partitions(existing.select(part, *keys), batch, part, max_prune_values)
    master_keys = master_keys.where(~all_null([F.col(k) for k in keys]))
    kept = anti_on(with_packed_key(batch, keys), master_keys.select(*packed_key(master_keys.schema, keys))).select(*batch.columns)
    group = [*keys, part]
    if output == "counts":
        values = as_list(value_cols) if value_cols else [c for c in batch.columns if c not in group]
        return kept.groupBy(*group).agg(*[F.count(c).alias(f"n_{c}") for c in values])
    if output == "one":
        rest = [c for c in batch.columns if c not in group]
        if not rest:
            return kept.select(*group).distinct()
        one = pick_row(kept, rest).alias("__row")
        return kept.groupBy(*group).agg(one).select(*group, *[F.col("__row").getField(c).alias(c) for c in rest])
    raise ValueError("output must be 'counts' or 'one'")


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _s(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_dedup_text(
    batch: DataFrame,
    existing: DataFrame,
    part: str,
    keys: str | Sequence[str],
    value_cols: Sequence[str] | None = None,
    output: str = "counts",
    max_prune_values: int = DEFAULT_MAX_PRUNE_VALUES,
) -> DataFrame:
    """:func:`sql_dedup` written as Spark SQL over temporary views, the way
    the baseline is usually run: a left outer join on ``<=>`` plus an
    ``IS NULL`` test.  Same result as :func:`sql_dedup`.

    The master side is the pruned, distinct key set, so a key present many
    times in master cannot multiply batch rows.  The views are dropped once
    the query is analysed (the plan keeps what it read).
    """
    keys = as_list(keys)
    spark = batch.sparkSession
    master_keys = prune_to_batch_partitions(existing.select(part, *keys), batch, part, max_prune_values)
    tag = uuid.uuid4().hex
    feed, master = f"increload_feed_{tag}", f"increload_master_{tag}"
    batch.createOrReplaceTempView(feed)
    master_keys.createOrReplaceTempView(master)
    try:
        rk = [f"rk{i}" for i in range(len(keys))]
        right = ", ".join(f"{_q(k)} AS {r}" for k, r in zip(keys, rk))
        not_all_null = " OR ".join(f"{_q(k)} IS NOT NULL" for k in keys)
        on = " AND ".join(f"lf.{_q(k)} <=> rt.{r}" for k, r in zip(keys, rk))
        unmatched = " AND ".join(f"rt.{r} IS NULL" for r in rk)
        kept = (
            f"SELECT lf.* FROM {feed} lf LEFT OUTER JOIN "
            f"(SELECT DISTINCT {right} FROM {master} WHERE {not_all_null}) rt ON {on} WHERE {unmatched}"
        )
        group = [*keys, part]
        group_sql = ", ".join(_q(c) for c in group)
        if output == "counts":
            values = as_list(value_cols) if value_cols else [c for c in batch.columns if c not in group]
            aggs = ", ".join(f"count({_q(c)}) AS {_q('n_' + c)}" for c in values)
            sql = f"SELECT {group_sql}, {aggs} FROM ({kept}) t GROUP BY {group_sql}"
        elif output == "one":
            rest = [c for c in batch.columns if c not in group]
            fields = ", ".join(f"{_s(c)}, {_q(c)}" for c in rest)
            picked = ", ".join(f"r.{_q(c)} AS {_q(c)}" for c in rest)
            ranks = ", ".join(_q(c) for c in rest if orderable(batch.schema[c].dataType))
            # the same choice as pick_row: by the columns that have an order
            if all(orderable(batch.schema[c].dataType) for c in rest):
                one = f"min(named_struct({fields}))"
            else:
                one = f"min_by(named_struct({fields}), struct({ranks}))" if ranks else f"first(named_struct({fields}))"
            sql = (
                f"SELECT {group_sql}, {picked} FROM (SELECT {group_sql}, {one} AS r FROM ({kept}) t GROUP BY {group_sql}) g"
                if rest
                else f"SELECT DISTINCT {group_sql} FROM ({kept}) t"
            )
        else:
            raise ValueError("output must be 'counts' or 'one'")
        return spark.sql(sql)
    finally:
        spark.catalog.dropTempView(feed)
        spark.catalog.dropTempView(master)
