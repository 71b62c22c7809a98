"""Helpers shared by the corpus operators.

Internal columns carry the prefix ``__llm_`` so that extra input columns,
whatever their names, never clash with them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from increload.session import shared_scratch

KEY = "__llm_key"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, whole."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the session's shared checkpoint folder and read it
    back: cuts the lineage, and a lost executor re-runs tasks over files that
    every other executor still sees."""
    path = f"{shared_scratch(df.sparkSession, 'llm')}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def matrix(rows: pa.Table, column: str) -> np.ndarray:
    """A collected array column, whose arrays are equally long, as a matrix."""
    values = rows.column(column).combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(len(values), -1) if len(values) else np.empty((0, 0))


def row_key(doc_id: Column, text: Column) -> Column:
    """Identity of a document row: its id and the hash of its text.

    Struct equality treats nulls as equal, so rows without an id or a text
    match themselves.  Rows equal in both are interchangeable.
    """
    return F.struct(doc_id.cast("long").alias("id"), F.xxhash64(text).alias("th"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def gapless(df: DataFrame, group: Sequence[str], sub: str, order: Sequence[str], out: str) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... by ``(sub, *order)``.

    Rows are ranked within ``(group, sub)`` only and shifted by the counts of
    the smaller ``sub`` values, so no task ever sorts a whole group.  ``df``
    must be a written table: it is read twice.  Group columns must not be null.
    """
    keys = [*group, sub]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__llm_n"))
    before = Window.partitionBy(*group).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, F.coalesce(F.sum("__llm_n").over(before), F.lit(0)).alias("__llm_base"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = df.withColumn("__llm_rn", rank)
    return (
        ranked.join(base, keys)
        .withColumn(out, (F.col("__llm_base") + F.col("__llm_rn") - 1).cast("long"))
        .drop("__llm_rn", "__llm_base")
    )
