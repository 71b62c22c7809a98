"""File sources: header CSV directories and input-file listings."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from increload.session import shared_scratch

# More kinds of headers than this in one directory are taken for a mistake.
MAX_HEADERS = 200
CORRUPT_COL = "__increload_corrupt"


@dataclass(frozen=True)
class CsvRead:
    """``rows``: the lines that fit their file's header, every column a string.
    ``rejected``: the others as ``(path, record, reason)``."""

    rows: DataFrame
    rejected: DataFrame


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """``(path, header)``: the first line of each file that is not blank.

    A scan of the lines with one running minimum per file, combined in each
    task: lines are numbered in the order they are read, and only the block at
    the start of a file counts.  A file without such a line gives no row.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("n"), "value",
    )
    starts = lines.where((F.col("at") == 0) & (F.trim("value") != ""))
    return starts.groupBy("path").agg(F.min_by("value", "n").alias("header"))


def header_names(header: str, sep: str = ",", quote: str = '"', trim: bool = False) -> list[str]:
    """Column names of a header line, as Spark's CSV reader names them: an
    empty name becomes ``_c<position>`` and a repeated one gets its position."""
    cells = next(csv.reader([header.removeprefix("\ufeff")], delimiter=sep, quotechar=quote))
    cells = [c.strip() for c in cells] if trim else cells
    names = [c or f"_c{i}" for i, c in enumerate(cells)]
    folded = [n.lower() for n in names]
    return [f"{n}{i}" if folded.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def _as_path(uri: str) -> str:
    """A path for the reader from a file's URI: decoded, pattern characters escaped."""
    plain = unquote(uri)
    return "".join(f"\\{c}" if c in "[]{}*?\\" else c for c in plain)


def read_csv_files(
    spark: SparkSession, path: str, part: str | None = None, source_col: str | None = None, dtype: str = "int",
    sep: str = ",", quote: str = '"', trim: bool = False, lenient: bool = False,
) -> CsvRead:
    """A directory of header CSVs, each file read by its own header.

    Files with equal headers are read together, and the groups are united by
    column name: swapped columns end up where they belong, and a column that a
    file lacks is null in its rows.  Columns come in the order of the first
    file (by path) that has them.  ``trim`` strips blanks around names first.

    Rejected, with a reason, are lines with more or fewer cells than their
    header (``lenient``: they are cut or filled with nulls instead), and, when
    ``part`` is to be derived from ``source_col``, rows whose value there does
    not cast to ``dtype``.  An absent value is no error: null is a partition of
    its own.  Every line is either in ``rows`` or in ``rejected``.

    One header, the usual case, means one plain scan of ``path``.  With more,
    file names reach the driver, which holds them for Spark's own listing too.
    Values that span lines are not supported.
    """
    found = _stage(read_headers(spark, path), "csv-headers")
    first = found.groupBy("header").agg(F.min("path").alias("first")).orderBy("first").limit(MAX_HEADERS + 1).collect()
    if not first:
        raise ValueError(f"no file with a header below {path}")
    if len(first) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers below {path}")
    groups: dict[tuple[str, ...], list[str]] = {}
    for r in first:
        groups.setdefault(tuple(header_names(r["header"], sep, quote, trim)), []).append(r["header"])
    derived = (part, source_col or part, dtype) if part is not None else None
    if derived and not any(derived[1] in names for names in groups):
        raise ValueError(f"no file below {path} has a column {derived[1]!r}")
    parts = []
    for names, headers in groups.items():
        if len(groups) == 1:
            paths = [path]
        else:
            paths = [_as_path(r["path"]) for r in found.where(F.col("header").isin(headers)).select("path").collect()]
        parts.append(_read_group(spark, paths, names, derived, sep, quote, lenient))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.rows for p in parts])
    if part is not None:
        rows = rows.select(*[c for c in rows.columns if c != part], part)
    return CsvRead(rows, reduce(DataFrame.unionByName, [p.rejected for p in parts]))


def _stage(df: DataFrame, name: str) -> DataFrame:
    out = shared_scratch(df.sparkSession, name)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def _read_group(
    spark: SparkSession, paths: Sequence[str], names: Sequence[str], derived: tuple[str, str, str] | None, sep: str, quote: str, lenient: bool
) -> CsvRead:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT_COL]])
    lines = (
        spark.read.schema(schema)
        .option("header", True).option("sep", sep).option("quote", quote)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT_COL)
        .option("columnPruning", False)  # else the cells of a line are not counted when few columns are wanted
        .csv(list(paths))
    )
    # Spark refuses plans that read the corrupt-record column alone, so the test names another one.
    line = F.concat(F.col(CORRUPT_COL), F.substring(F.coalesce(F.col(f"`{names[0]}`"), F.lit("")), 1, 0))
    malformed = F.lit(False) if lenient else line.isNotNull()
    cells = [F.col(f"`{n}`") for n in names]
    uncast = F.lit(False)
    if derived and derived[1] in names:
        source = F.col(f"`{derived[1]}`")
        uncast = source.isNotNull() & source.try_cast(derived[2]).isNull()
    reason = F.when(malformed, F.lit(f"not {len(names)} cells")).when(
        uncast, F.lit(f"{derived[1]} is no {derived[2]}" if derived else None)
    )
    record = F.when(malformed, line).otherwise(F.to_csv(F.struct(*cells), {"sep": sep, "quote": quote}))
    rejected = lines.where(malformed | uncast).select(F.col("_metadata.file_path").alias("path"), record.alias("record"), reason.alias("reason"))
    good = lines.where(~malformed & ~uncast)
    if derived:
        name, source_col, dtype = derived
        value = F.col(f"`{source_col}`") if source_col in names else F.lit(None).cast("string")
        rest = [c for c, n in zip(cells, names, strict=True) if n != name]
        return CsvRead(good.select(*rest, value.try_cast(dtype).alias(name)), rejected)
    return CsvRead(good.select(*cells), rejected)


def read_csv_dir(spark: SparkSession, path: str) -> DataFrame:
    """A directory of header CSVs, every column read as a string (no inference),
    each file by its own header.  Short lines are filled with nulls and long
    ones cut; :func:`read_csv_files` gives such lines apart."""
    return read_csv_files(spark, path, lenient=True).rows


def trim_column_names(df: DataFrame) -> DataFrame:
    """Strip blanks around every column name (headers like ``" name"``)."""
    return df.toDF(*[c.strip() for c in df.columns])


def with_partition_column(df: DataFrame, name: str, source_col: str, dtype: str = "int") -> DataFrame:
    """Derive the partition column by casting ``source_col``; bad text becomes
    null (:func:`read_csv_files` rejects it instead)."""
    return df.withColumn(name, F.col(source_col).try_cast(dtype))


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark names its files: scheme and authority of the path's
    (or the default) file system, absolute, no trailing slash."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(hadoop).toString().rstrip("/")


# What Hadoop's path patterns are made of, and their meaning within one segment.
_GLOB = {"*": "[^/]*", "?": "[^/]"}


def _pattern(path: str) -> str:
    """Regular expression for the files below ``path``, which may hold ``*``,
    ``?``, ``[...]`` and ``{a,b}``.  The first group is the next segment."""
    out, braces, i = [], 0, 0
    while i < len(path):
        ch = path[i]
        if ch == "[" and "]" in path[i:]:
            end = path.index("]", i)
            out.append(path[i : end + 1])
            i = end
        elif ch == "{" and "}" in path[i:]:
            braces += 1
            out.append("(?:")
        elif ch == "}" and braces:
            braces -= 1
            out.append(")")
        elif ch == "," and braces:
            out.append("|")
        else:
            out.append(_GLOB.get(ch) or ("\\" + ch if not ch.isalnum() and ch.isascii() else ch))
        i += 1
    return "^" + "".join(out) + "/+([^/]+)"


def below(path: Column, pattern: str) -> Column:
    """The segment below the base; a path that is not below it raises."""
    segment = F.regexp_extract(path, pattern, 1)
    return F.when(segment != "", segment).otherwise(F.raise_error(F.concat(F.lit("not below the listed path: "), path)).cast("string"))


def list_input_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` as rows ``(path, segment, length)``, contents not read.

    ``segment`` is the name directly below ``path``: the file name, or the
    directory it sits in (e.g. ``date=20170101``).  ``path`` may be relative
    (to the default file system's working directory) and may hold a pattern;
    the segment is then the name below the directories it matches.  Spark's
    listing skips empty files and names starting with ``_`` or ``.``
    and is distributed on large trees.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.select("path", below(F.col("path"), _pattern(_qualified(spark, path))).alias("segment"), "length")
