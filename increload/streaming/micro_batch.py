"""Run the stored load once per Structured Streaming micro-batch.

Each micro-batch becomes one load batch: de-duplicated, filtered against
everything loaded before, appended, then indexed.  A stream gets a number the
first time it runs with a given checkpoint location, stored under ``base``;
its epoch ``e`` is batch ``number * 2**52 + e``.  Load jobs use ids below
``2**52``, so the ids of jobs and streams never meet, and a restarted query
maps every epoch to the same batch.  Whether an epoch is loaded is what the
commit log says: one that is committed is not written again, any other is
loaded, whatever was loaded or compacted in between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from increload.functions.keys import key_columns
from increload.plans.job import STREAM_IDS, load_batch
from increload.session import one_row
from increload.sources import tables

STREAMS = "streams"
STREAM_SCHEMA = T.StructType([T.StructField("number", T.LongType()), T.StructField("checkpoint", T.StringType())])


def stream_number(spark: SparkSession, base: str, checkpoint_location: str) -> int:
    """The number (from 1) of the stream with this checkpoint location."""
    tag = "c" + hashlib.sha1(checkpoint_location.rstrip("/").encode()).hexdigest()
    root = f"{base.rstrip('/')}/{STREAMS}"
    known = {r["checkpoint"]: int(r["number"]) for r in tables.read_or_empty(spark, STREAM_SCHEMA, root).collect()}  # one row per stream
    if tag not in known:
        known[tag] = max(known.values(), default=0) + 1
        row = one_row(spark, T.StructType(STREAM_SCHEMA.fields[:1]), (known[tag],))
        row.write.mode("overwrite").parquet(f"{root}/checkpoint={tag}")
    return known[tag]


def drop_recent_copies(stream: DataFrame, part: str | None, keys: str | Sequence[str], recent: str, scope: str = "partition") -> DataFrame:
    """``stream`` without rows whose key came within ``recent`` before.

    Spark's state store remembers each key for that long, spread over the
    shuffle partitions; what it holds is bounded by the keys that arrive in the
    time, not by all loaded ones.  The time is that of arrival (of the
    micro-batch, as recorded for its replay), not one of the rows' own columns:
    by event time Spark would drop rows that come late, whether copies or not.
    Of copies that arrive together any one may stay.  Null keys are a value.
    """
    named = {f"__key{i}": F.col(c) for i, c in enumerate(key_columns(part, keys, scope))}
    arriving = stream.withColumns(named | {"__arrival": F.current_timestamp()}).withWatermark("__arrival", recent)
    return arriving.dropDuplicatesWithinWatermark(list(named)).select(*stream.columns)


def load_stream(
    stream: DataFrame,
    base: str,
    part: str | None,
    keys: str | Sequence[str],
    checkpoint_location: str,
    order_by: Sequence[str] | None = None,
    scope: str = "partition",
    trigger: dict | None = None,
    compact_every: int = 50,
    recent: str | None = None,
) -> StreamingQuery:
    """Start a streaming query that loads every micro-batch into ``base``.

    ``recent`` (``"2 hours"``) puts :func:`drop_recent_copies` in front: copies
    that arrive within that time of the first never reach a load.  Later ones
    do, and are dropped there, so the master has the same keys either way.

    Every ``compact_every`` epochs the batches since the last time are merged
    into a segment (index and master), and every ``compact_every`` segments
    into one, so the directories that a load opens stay bounded however long
    the stream runs.  0 leaves that to the caller.
    """
    spark = stream.sparkSession
    first = stream_number(spark, base, checkpoint_location) * STREAM_IDS
    schema = stream.schema
    key_schema = tables.key_schema_of(schema, part, keys)

    def load(batch: DataFrame, epoch_id: int) -> None:
        session = batch.sparkSession
        load_batch(session, batch, base, first + epoch_id, part, keys, order_by, scope)
        if compact_every and (epoch_id + 1) % compact_every == 0:
            state = tables.read_state(session, base)
            tables.compact_key_index(session, base, key_schema, part, full=len(state.index_segments) >= compact_every)
            tables.compact_master(session, base, schema, part, full=len(state.data_segments) >= compact_every)

    if recent is not None:
        stream = drop_recent_copies(stream, part, keys, recent, scope)
    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint_location)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
