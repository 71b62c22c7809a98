"""Incremental de-duplicating loads on Spark DataFrames."""

from increload.operators.antijoin import anti_join_keys, prune_to_batch_partitions
from increload.operators.audit import audit_assumptions
from increload.operators.dedup import dedup_batch
from increload.operators.keyindex import (
    batch_partitions,
    build_key_index,
    index_profile,
    merge_key_index,
    partition_count,
    select_keys,
)
from increload.operators.layout import (
    bucket_profile,
    estimate_partitions,
    estimate_partitions_by_bytes,
    estimate_partitions_by_date,
    estimate_partitions_by_files,
    layout_by_bucket,
    require_partitions,
    with_bucket,
)
from increload.operators.reconcile import corrected_index, reconcile_index
from increload.operators.setops import except_rows, replay_split
from increload.plans.job import LoadReport, run_load_job
from increload.plans.load import LoadResult, incremental_load
from increload.plans.sql_baseline import sql_dedup, sql_dedup_text
from increload.sources.files import list_input_files, read_csv_dir, read_csv_files, trim_column_names, with_partition_column
from increload.sources.key_table import KeyTable
from increload.sources.tables import (
    append_delta,
    compact_key_index,
    compact_master,
    existing_keys,
    index_coverage,
    read_key_index,
    read_master,
    write_key_index,
)

__all__ = [
    "KeyTable",
    "LoadReport",
    "LoadResult",
    "anti_join_keys",
    "append_delta",
    "audit_assumptions",
    "batch_partitions",
    "bucket_profile",
    "compact_key_index",
    "compact_master",
    "build_key_index",
    "corrected_index",
    "dedup_batch",
    "estimate_partitions",
    "estimate_partitions_by_bytes",
    "estimate_partitions_by_date",
    "estimate_partitions_by_files",
    "except_rows",
    "existing_keys",
    "incremental_load",
    "index_coverage",
    "index_profile",
    "layout_by_bucket",
    "list_input_files",
    "merge_key_index",
    "partition_count",
    "prune_to_batch_partitions",
    "read_csv_dir",
    "read_csv_files",
    "read_key_index",
    "read_master",
    "reconcile_index",
    "replay_split",
    "require_partitions",
    "run_load_job",
    "select_keys",
    "sql_dedup",
    "sql_dedup_text",
    "trim_column_names",
    "with_bucket",
    "with_partition_column",
    "write_key_index",
]
