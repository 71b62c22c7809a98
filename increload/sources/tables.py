"""Crash-safe storage of the master table, the key index and batch commits.

Layout under ``base`` (a directory is written once and never changed):

    master/batch_id=K/attempt=A/<part>=v/      delta rows of batch K, written by attempt A
    index/batch_id=K/attempt=A/<part>=v/       key tuples of batch K's delta
    commits/gen=G/stage=S/batch_id=K/          one row: stage S (data, index) of batch K is attempt A
    master_compact/segment=G/<part>=v/         delta rows of many batches
    index_compact/segment=G/<part>=v/          key tuples of many batches
    commits_compact/gen=G/                     every commit row at the start of generation G
    generations/gen=G/                         marker, written last

The commit row is the switch: it names the attempt whose files count, so a
failed or repeated attempt leaves files that nobody reads and never touches
committed ones.  A batch with a ``data`` but no ``index`` commit has its keys
read from its own master files.

A compaction copies batches into a segment, rolls the commit log over to the
next generation with the batches' rows pointing to the segment, and then
writes the generation's marker.  Which batches a segment holds is what the
commit rows say, never a range of ids.  Readers open the newest generation:
the segments, and one directory for each batch committed since.  One writer
per ``base`` at a time (plain Parquet has no cross-job lock).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from increload.functions.keys import as_list
from increload.session import no_rows, one_row

MASTER = "master"
INDEX = "index"
COMPACT = {MASTER: "master_compact", INDEX: "index_compact"}
STAGE = {MASTER: "data", INDEX: "index"}
COMMITS = "commits"
COMMITS_COMPACT = "commits_compact"
GENERATIONS = "generations"
BATCH_COL = "batch_id"
ATTEMPT_COL = "attempt"

COMMIT_SCHEMA = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField(ATTEMPT_COL, T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("segment", T.LongType()),
        T.StructField("stage", T.StringType()),
        T.StructField(BATCH_COL, T.LongType()),
    ]
)
MARKER_SCHEMA = T.StructType([T.StructField("n", T.LongType()), T.StructField("gen", T.LongType())])


def _join(base: str, *parts: str) -> str:
    return "/".join([base.rstrip("/"), *parts])


def new_attempt() -> str:
    return uuid.uuid4().hex


def batch_dir(base: str, area: str, batch_id: int, attempt: str) -> str:
    return _join(base, area, f"{BATCH_COL}={int(batch_id)}", f"{ATTEMPT_COL}={attempt}")


def segment_dir(base: str, area: str, segment: int) -> str:
    return _join(base, COMPACT[area], f"segment={int(segment)}")


def _missing_path(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e)


def read_or_empty(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """Parquet at ``path`` read with ``schema``; an empty frame when the path does not exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if not _missing_path(e):
            raise
        return no_rows(spark, schema)


def generation(spark: SparkSession, base: str) -> int:
    """The newest committed generation; 0 before any compaction."""
    newest = read_or_empty(spark, MARKER_SCHEMA, _join(base, GENERATIONS)).agg(F.max("gen")).first()[0]
    return int(newest or 0)


def read_commits(spark: SparkSession, base: str, gen: int | None = None) -> DataFrame:
    """All commit rows ``(batch_id, stage, n, attempt, tag, segment)``."""
    gen = generation(spark, base) if gen is None else gen
    names = [BATCH_COL, "stage", "n", ATTEMPT_COL, "tag", "segment"]
    rows = read_or_empty(spark, COMMIT_SCHEMA, _join(base, COMMITS, f"gen={gen}")).select(*names)
    if gen:
        old = spark.read.schema(COMMIT_SCHEMA).parquet(_join(base, COMMITS_COMPACT, f"gen={gen}"))
        rows = old.select(*names).unionByName(rows)
    return rows


def write_commit(
    spark: SparkSession, base: str, stage: str, batch_id: int, n: int, attempt: str, tag: str | None = None, gen: int | None = None
) -> None:
    """Record that ``attempt`` is stage ``stage`` of batch ``batch_id``."""
    gen = generation(spark, base) if gen is None else gen
    row = one_row(spark, T.StructType(COMMIT_SCHEMA.fields[:4]), (int(n), attempt, tag, None))
    path = _join(base, COMMITS, f"gen={gen}", f"stage={stage}", f"{BATCH_COL}={int(batch_id)}")
    row.write.mode("overwrite").parquet(path)


def coverage_of(commits: DataFrame) -> DataFrame:
    """Per committed data batch: ``(batch_id, n_rows, has_index)``.

    Index commits without a data commit are ignored.
    """
    data = commits.where(F.col("stage") == "data").groupBy(BATCH_COL).agg(F.max("n").alias("n_rows"))
    idx = commits.where(F.col("stage") == "index").select(BATCH_COL, F.lit(True).alias("__idx")).distinct()
    return data.join(idx, BATCH_COL, "left").select(
        BATCH_COL, "n_rows", F.coalesce(F.col("__idx"), F.lit(False)).alias("has_index")
    )


def index_coverage(spark: SparkSession, base: str) -> DataFrame:
    """Which committed batches have a usable index (replaces "the path exists")."""
    return coverage_of(read_commits(spark, base))


@dataclass(frozen=True)
class Commit:
    """A committed batch: rows, what it was made from, and where its rows and
    keys are (an attempt's directory, or a segment)."""

    batch_id: int
    n: int
    tag: str | None
    data: str | None
    data_segment: int | None
    index: str | None
    index_segment: int | None

    @property
    def has_index(self) -> bool:
        return self.index is not None or self.index_segment is not None


@dataclass(frozen=True)
class State:
    """What a load needs to know of the commit log: the batches that lie in
    directories of their own, and the segments that hold all others.  Its
    size follows the batches since the latest compactions, not all loads."""

    gen: int
    batches: dict[int, Commit]
    data_segments: tuple[int, ...]
    index_segments: tuple[int, ...]
    asked: Commit | None = None

    @property
    def loaded(self) -> bool:
        """Is any batch loaded (beside the one asked for)?"""
        return bool(self.batches or self.index_segments or self.data_segments)

    @property
    def missing(self) -> tuple[int, ...]:
        """Batches whose index is not committed."""
        return tuple(sorted(b for b, c in self.batches.items() if not c.has_index))


def read_state(spark: SparkSession, base: str, batch_id: int | None = None) -> State:
    """The commit log's state.  The batch ``batch_id`` is reported apart, as
    ``asked``, and its own directories count neither as batch nor segment."""
    gen = generation(spark, base)

    def of(stage: str):
        fields = F.struct("n", F.struct(ATTEMPT_COL, "segment").alias("at"), "tag")
        return F.max(F.when(F.col("stage") == stage, fields)).alias(stage)

    per_batch = read_commits(spark, base, gen).groupBy(BATCH_COL).agg(of("data"), of("index")).where("data is not null")
    segmented = F.col("data.at.segment").isNotNull() & F.col("index.at.segment").isNotNull()
    if batch_id is not None:
        segmented = segmented & (F.col(BATCH_COL) != int(batch_id))
    own = ~segmented
    rows = per_batch.select(
        F.when(own, F.col(BATCH_COL)).alias("id"), F.when(own, F.col("data.n")).alias("n"), F.when(own, F.col("data.tag")).alias("tag"),
        F.when(own, F.col(f"data.at.{ATTEMPT_COL}")).alias("data"), F.col("data.at.segment").alias("data_segment"),
        F.when(own, F.col(f"index.at.{ATTEMPT_COL}")).alias("index"), F.col("index.at.segment").alias("index_segment"),
    ).distinct().collect()
    batches = {r["id"]: Commit(*r) for r in rows if r["id"] is not None}
    asked = batches.pop(int(batch_id), None) if batch_id is not None else None
    others = [r for r in rows if r["id"] is None or r["id"] in batches]
    segments = [tuple(sorted({r[c] for r in others if r[c] is not None})) for c in ("data_segment", "index_segment")]
    return State(gen, batches, *segments, asked)


def _with_batch(schema: T.StructType) -> T.StructType:
    fields = [f for f in schema.fields if f.name != BATCH_COL]
    return T.StructType([*fields, T.StructField(BATCH_COL, T.LongType())])


def _read_attempts(spark: SparkSession, base: str, area: str, attempts: dict[int, str], schema: T.StructType) -> DataFrame:
    """Rows of the named attempts with their batch id.  Explicit directories:
    no other attempt is listed or read."""
    full = _with_batch(schema)
    stored = T.StructType([*full.fields, T.StructField(ATTEMPT_COL, T.StringType())])
    paths = [batch_dir(base, area, b, a) for b, a in sorted(attempts.items())]
    return spark.read.option("basePath", _join(base, area)).schema(stored).parquet(*paths).select(*full.fieldNames())


def _read_segments(spark: SparkSession, base: str, area: str, segments: Sequence[int], schema: T.StructType) -> list[DataFrame]:
    full = _with_batch(schema)
    return [spark.read.schema(full).parquet(segment_dir(base, area, s)).select(*full.fieldNames()) for s in segments]


def _sources(spark: SparkSession, base: str, area: str, state: State, schema: T.StructType, segments: bool = True) -> list[DataFrame]:
    """Rows of every loaded batch from where they are: ``MASTER`` rows, or
    ``INDEX`` keys with those of batches without an index taken from master."""
    out = _read_segments(spark, base, area, state.data_segments if area == MASTER else state.index_segments, schema) if segments else []
    name = "data" if area == MASTER else "index"
    own = {b: getattr(c, name) for b, c in state.batches.items() if getattr(c, f"{name}_segment") is None}
    here = {b: a for b, a in own.items() if a is not None}
    if here:
        out.append(_read_attempts(spark, base, area, here, schema))
    if area == INDEX:
        rest = [c for c in state.batches.values() if not c.has_index]
        at_home = {c.batch_id: c.data for c in rest if c.data_segment is None}
        if at_home:
            out.append(_read_attempts(spark, base, MASTER, at_home, schema))
        merged = [c.batch_id for c in rest if c.data_segment is not None]
        if merged:
            held = sorted({c.data_segment for c in rest if c.data_segment is not None})
            out += [df.where(F.col(BATCH_COL).isin(merged)) for df in _read_segments(spark, base, MASTER, held, schema)]
    return out


def _union(parts: list[DataFrame], spark: SparkSession, schema: T.StructType) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else no_rows(spark, _with_batch(schema))


def _rebalanced_writer(df: DataFrame, part: str | None, last: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Writer partitioned by ``part``; AQE rebalances rows first so that each
    partition value lands in few files (a hot value is split, small ones are
    merged).  ``last`` is applied to the rows as they are written."""
    if part is None:
        return last(df.hint("rebalance")).write
    return last(df.hint("rebalance", part)).write.partitionBy(part)


def append_delta(
    df: DataFrame, base: str, batch_id: int, part: str | None, attempt: str,
    last: Callable[[DataFrame], DataFrame] = lambda df: df, placed: bool = False,
) -> None:
    """Write one batch's delta to the attempt's own directory.  ``last``, say
    an observation, is applied to the rows as they are written; ``placed``
    rows are written in the partitions they come in."""
    df, path = df.drop(BATCH_COL), batch_dir(base, MASTER, batch_id, attempt)
    if not placed:
        _rebalanced_writer(df, part, last).parquet(path)
    elif part is None:
        last(df).write.parquet(path)
    else:
        last(df).write.partitionBy(part).parquet(path)


def write_key_index(keys: DataFrame, base: str, batch_id: int, part: str | None, attempt: str) -> None:
    """Write one batch's key tuples to the attempt's own index directory."""
    _rebalanced_writer(keys.drop(BATCH_COL), part).parquet(batch_dir(base, INDEX, batch_id, attempt))


def read_attempt(spark: SparkSession, base: str, batch_id: int, attempt: str, schema: T.StructType) -> DataFrame:
    """The rows that one attempt wrote, committed or not."""
    return spark.read.schema(schema).parquet(batch_dir(base, MASTER, batch_id, attempt))


def read_master(
    spark: SparkSession, base: str, schema: T.StructType, batch_ids: Iterable[int] | None = None, exclude: Iterable[int] = ()
) -> DataFrame:
    """Rows of committed batches, with a ``batch_id`` column.

    ``schema`` (the batch schema) pins column types, including the partition
    column, which directory discovery would otherwise infer from its text.
    """
    out = _union(_sources(spark, base, MASTER, read_state(spark, base), schema), spark, schema)
    if batch_ids is not None:
        out = out.where(F.col(BATCH_COL).isin([int(b) for b in batch_ids]))
    skip = [int(b) for b in exclude]
    return out.where(~F.col(BATCH_COL).isin(skip)) if skip else out


def read_key_index(spark: SparkSession, base: str, key_schema: T.StructType, exclude: Iterable[int] = ()) -> DataFrame:
    """The stored index ``(part, *keys, batch_id)`` of the batches whose index is committed."""
    state = read_state(spark, base)
    indexed = {b: c for b, c in state.batches.items() if c.has_index}
    state = State(state.gen, indexed, state.data_segments, state.index_segments)
    out = _union(_sources(spark, base, INDEX, state, key_schema), spark, key_schema)
    skip = [int(b) for b in exclude]
    return out.where(~F.col(BATCH_COL).isin(skip)) if skip else out


def key_schema_of(schema: T.StructType, part: str | None, keys: str | Sequence[str]) -> T.StructType:
    cols = ([part] if part is not None else []) + as_list(keys)
    return T.StructType([schema[c] for c in dict.fromkeys(cols)])


def existing_keys(spark: SparkSession, base: str, key_schema: T.StructType, state: State | None = None) -> DataFrame | None:
    """Every loaded key tuple: the stored index where it is committed, plus
    the keys of committed batches whose index is missing, read (column-pruned)
    from their master files.  ``None`` when nothing is loaded.
    """
    state = state if state is not None else read_state(spark, base)
    if not state.loaded:
        return None
    cols = key_schema.fieldNames()
    return reduce(DataFrame.unionByName, [p.select(*cols) for p in _sources(spark, base, INDEX, state, key_schema)])


def _roll(spark: SparkSession, base: str, gen: int, stage: str, moved: DataFrame) -> int:
    """Start the next generation: the rows of ``stage`` for the batches in
    ``moved`` point to segment ``gen + 1``, all others stay as they are."""
    new = gen + 1
    rows = read_commits(spark, base, gen)
    data = rows.where(F.col("stage") == "data").join(moved, BATCH_COL, "left_semi")
    rest = rows.where(F.col("stage") != stage).unionByName(rows.where(F.col("stage") == stage).join(moved, BATCH_COL, "left_anti"))
    there = data.withColumn("stage", F.lit(stage)).withColumn("segment", F.lit(new).cast("long"))
    out = rest.unionByName(there).select(*COMMIT_SCHEMA.fieldNames())
    out.write.mode("overwrite").parquet(_join(base, COMMITS_COMPACT, f"gen={new}"))
    marker = one_row(spark, T.StructType(MARKER_SCHEMA.fields[:1]), (1,))
    marker.write.mode("overwrite").parquet(_join(base, GENERATIONS, f"gen={new}"))
    return new


def _compact(
    spark: SparkSession, base: str, area: str, schema: T.StructType, part: str | None, batch_ids: Iterable[int] | None, full: bool
) -> int:
    state = read_state(spark, base)
    name = "data_segment" if area == MASTER else "index_segment"
    fresh = {b: c for b, c in state.batches.items() if getattr(c, name) is None}
    if batch_ids is not None:
        wanted = {int(b) for b in batch_ids}
        fresh = {b: c for b, c in fresh.items() if b in wanted}
    segments = state.data_segments if area == MASTER else state.index_segments
    if not fresh and not (full and len(segments) > 1):
        return state.gen
    take = State(state.gen, fresh, state.data_segments, state.index_segments)
    merged = _union(_sources(spark, base, area, take, schema, segments=full), spark, schema)
    # A compaction that died before its marker left this directory behind, unread.
    _rebalanced_writer(merged, part).mode("overwrite").parquet(segment_dir(base, area, state.gen + 1))
    ids = spark.createDataFrame([(b,) for b in fresh], f"{BATCH_COL} long")
    if full:
        commits = read_commits(spark, base, state.gen)
        held = commits.where((F.col("stage") == STAGE[area]) & F.col("segment").isNotNull()).select(BATCH_COL)
        ids = ids.unionByName(held).distinct()
    return _roll(spark, base, state.gen, STAGE[area], ids)


def compact_key_index(
    spark: SparkSession, base: str, key_schema: T.StructType, part: str | None, batch_ids: Iterable[int] | None = None, full: bool = False
) -> int:
    """Merge the index of the batches that have a directory of their own
    (``batch_ids``: only those) into one segment, and return the generation.

    Batches without an index commit get their keys from master here.
    ``full=True`` folds the earlier segments in too, leaving one; otherwise a
    compaction costs what was added since the last.  A compacted batch is
    still committed: loading it again changes nothing.
    """
    return _compact(spark, base, INDEX, key_schema, part, batch_ids, full)


def compact_master(
    spark: SparkSession, base: str, schema: T.StructType, part: str | None, batch_ids: Iterable[int] | None = None, full: bool = False
) -> int:
    """:func:`compact_key_index` for the master rows: readers then open a
    segment instead of one directory per batch."""
    return _compact(spark, base, MASTER, schema, part, batch_ids, full)
