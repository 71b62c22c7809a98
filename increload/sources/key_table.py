"""The key index as a bucketed table: loads move the batch, never the index.

A key tuple is stored with its packed form ``(hash, struct)`` in Parquet files
bucketed by that pair, below a directory for its partition value.  Spark then
knows how the table is distributed: joining a batch on the same pair shuffles
the batch alone, to the bucket count, and each task reads one bucket of the
partitions that the batch touches.  Files are sorted by the hash, so a batch of
few keys reads only the pages that may hold them.

It is an ordinary external table of the session's catalog.  A catalog that
forgets tables between sessions gets it back from ``open``, which declares the
files at ``path`` again and lists their partitions.

The index is a set of keys: :meth:`KeyTable.append` of a delta that is already
in leaves doubled entries and changes no load.  Append after the delta itself
is written.  A run that dies in between leaves an index without those keys;
:mod:`increload.operators.reconcile` finds and :meth:`append` adds them.  One
writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from increload.functions.keys import HASH_COL, KEY_COL, KEY_COLS, as_list, key_columns, with_packed_key
from increload.sources.tables import read_or_empty

# A batch of up to so many keys is looked up in so many ranges of the hash.
ZONE_KEYS = 1000
ZONES = 64


def _nullable(dtype: T.DataType) -> T.DataType:
    """The type as Parquet gives it back: everything may be null."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_nullable(dtype.elementType), True)
    return dtype


@dataclass(frozen=True)
class KeyTable:
    """``columns``: the identifying columns, the partition column first."""

    spark: SparkSession
    name: str
    path: str
    part: str | None
    keys: tuple[str, ...]
    scope: str
    buckets: int
    schema: T.StructType

    @property
    def columns(self) -> list[str]:
        return key_columns(self.part, self.keys, self.scope)

    @property
    def key_type(self) -> T.StructType:
        return _nullable(T.StructType([self.schema[c] for c in self.columns]))

    @classmethod
    def open(
        cls, spark: SparkSession, name: str, path: str, schema: T.StructType, part: str | None, keys: str | Sequence[str],
        buckets: int, scope: str = "partition",
    ) -> KeyTable:
        """The key table ``name`` at ``path``, declared when the catalog does
        not have it.  ``schema`` gives the types of the key columns (a batch's
        schema will do).  ``buckets`` is fixed for the life of the table; it
        must be the session's number of shuffle partitions or more, or else
        Spark shuffles the table to that number like any other."""
        if buckets < 1:
            raise ValueError("buckets must be >= 1")
        keys = tuple(as_list(keys))
        flat = [*([part] if part is not None else []), *keys]
        table = cls(spark, name, path, part, keys, scope, buckets, T.StructType([schema[c] for c in dict.fromkeys(flat)]))
        if not spark.catalog.tableExists(name):
            table._declare()
        return table

    def _declare(self) -> None:
        def quoted(c: str) -> str:
            return f"`{c.replace('`', '``')}`"

        fields = [(HASH_COL, "BIGINT"), (KEY_COL, self.key_type.simpleString()), *[(f.name, f.dataType.simpleString()) for f in self.schema.fields]]
        columns = ", ".join(f"{quoted(n)} {t}" for n, t in fields)
        part = f"PARTITIONED BY ({quoted(self.part)})" if self.part is not None else ""
        location = self.path.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE {self.name} ({columns}) USING parquet {part} "
            f"CLUSTERED BY ({HASH_COL}, {KEY_COL}) SORTED BY ({HASH_COL}) INTO {self.buckets} BUCKETS LOCATION '{location}'"
        )
        if self.part is not None and self._stored():
            self.spark.catalog.recoverPartitions(self.name)

    def _stored(self) -> bool:
        """Are there files yet?  (A catalog lists partitions of existing folders only.)"""
        return not read_or_empty(self.spark, T.StructType(self.schema.fields), self.path).isEmpty()

    def packed(self, df: DataFrame) -> DataFrame:
        """``df`` with its packed key, typed as the table stores it."""
        return with_packed_key(df, self.columns).withColumn(KEY_COL, F.col(KEY_COL).cast(self.key_type))

    def rows(self) -> DataFrame:
        """``(hash, struct, part, *keys)`` of every key in the table."""
        return self.spark.table(self.name)

    def near(self, known: DataFrame, batch: DataFrame) -> DataFrame:
        """``known`` (rows of this table) without most of those that ``batch``
        cannot match, for a batch of few keys: its hashes, in at most
        ``ZONES`` ranges, become a filter on the scan.  Files are sorted by the
        hash, so Parquet skips row groups and pages outside all ranges."""
        hashes = sorted(r[0] for r in batch.select(HASH_COL).distinct().limit(ZONE_KEYS + 1).collect())
        if not hashes or len(hashes) > ZONE_KEYS:
            return known
        gaps = sorted(range(1, len(hashes)), key=lambda i: hashes[i - 1] - hashes[i])[: ZONES - 1]  # the widest
        edges = [0, *sorted(gaps), len(hashes)]
        tests = [F.col(HASH_COL).between(hashes[a], hashes[b - 1]) for a, b in zip(edges, edges[1:])]
        while len(tests) > 1:  # a shallow tree
            tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + tests[len(tests) // 2 * 2 :]
        return known.where(tests[0])

    def index(self) -> DataFrame:
        """The keys as a flat index ``(part, *keys)``."""
        return self.rows().select(*self.schema.fieldNames())

    def append(self, df: DataFrame) -> None:
        """Add the keys of ``df``, each once: one file per partition value and bucket."""
        if self.part is not None and isinstance(self.schema[self.part].dataType, T.StringType):
            if not df.where(F.col(self.part) == "").isEmpty():
                raise ValueError(f"an empty string in {self.part!r} cannot be stored as a partition value; use null or another value")
        keys = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).distinct()
        dealt = self.packed(keys).repartition(self.buckets, *KEY_COLS)
        columns = [HASH_COL, KEY_COL, *[c for c in self.schema.fieldNames() if c != self.part], *([self.part] if self.part is not None else [])]
        writer = dealt.select(*columns).write.mode("append").format("parquet").bucketBy(self.buckets, *KEY_COLS).sortBy(HASH_COL)
        if self.part is not None:
            writer = writer.partitionBy(self.part)
        writer.saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)
