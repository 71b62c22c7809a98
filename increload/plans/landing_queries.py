"""Queries over landed files: headers, rejected lines, sizing.

The driver's events are written as the files a producer would drop; the
library then reads those files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from increload.functions.keys import date_token
from increload.operators.layout import estimate_partitions
from increload.plans.catalog import _EV, _SQL_STREAM_LOAD, events
from increload.plans.job import run_load_job
from increload.session import shared_scratch
from increload.sources.files import list_input_files, read_csv_files
from increload.sources.tables import read_master

def _text_columns(df: DataFrame) -> DataFrame:
    """Every column as text that reads the same everywhere."""
    df = df.withColumns({"ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "value": F.col("value").cast("decimal(20,4)")})
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def q_csv_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events exported by three systems into one place: one in the table's
    column order, one in the reverse order, one without ``props`` but with an
    ``origin`` and blanks around its names.  Read as one table by name."""
    root = shared_scratch(spark, "csv-headers-demo")
    ev = events(spark, sf_dir)
    system = F.pmod("user_id", F.lit(3))
    names = ev.columns
    first = _text_columns(ev.where(system == 0))
    second = _text_columns(ev.where(system == 1)).select(*reversed(names))
    third = _text_columns(ev.where((system == 2) | system.isNull())).drop("props").withColumn("origin", F.lit("web, mobile"))
    third = third.select(*[F.col(c).alias(c if i == 0 else f" {c} ") for i, c in enumerate(third.columns)])
    for name, df in (("a", first), ("b", second), ("c", third)):
        df.write.option("header", True).csv(f"{root}/{name}")
    return read_csv_files(spark, f"{root}/*", part="part", source_col="day", trim=True).rows


_EV_TEXT = """
    CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, CAST(CAST(value AS DECIMAL(20,4)) AS VARCHAR) AS value,
    CAST(day AS VARCHAR) AS day"""

_SQL_CSV_HEADERS = f"""
WITH {_EV}
SELECT {_EV_TEXT}, CASE WHEN user_id % 3 IN (0, 1) THEN props END AS props,
       CASE WHEN coalesce(user_id % 3 = 2, true) THEN 'web, mobile' END AS origin, day AS part
FROM ev
"""


def _event_line() -> Column:
    by = lambda n: F.pmod("user_id", F.lit(n)) == 0
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = [text("event_id"), text("user_id")]
    whole = [*head, text("event_type")]
    return (
        F.when(by(29), F.concat_ws(",", *head))
        .when(by(31), F.concat_ws(",", *whole, text("day"), F.lit("surplus")))
        .when(by(23), F.concat_ws(",", *whole, F.lit("unknown")))
        .otherwise(F.concat_ws(",", *whole, text("day")))
    )


def q_csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as CSV files in which some lines are cut short, some have a cell
    too many and some an unreadable day: what becomes of every line."""
    root = shared_scratch(spark, "csv-rejects-demo")
    lines = events(spark, sf_dir).select(F.coalesce(F.pmod("user_id", F.lit(5)), F.lit(0)).alias("file"), F.lit(1).alias("at"), _event_line().alias("value"))
    heads = lines.select("file").distinct().select("file", F.lit(0).alias("at"), F.lit("event_id,user_id,event_type,day").alias("value"))
    ordered = heads.unionByName(lines).repartition("file").sortWithinPartitions("file", "at")
    ordered.select("file", "value").write.partitionBy("file").text(root)  # a file each, its header first
    read = read_csv_files(spark, f"{root}/file=*", part="part", source_col="day")
    cells = [F.coalesce(F.col(c), F.lit("")) for c in ("event_id", "user_id", "event_type", "day")]
    loaded = read.rows.select(F.lit("loaded").alias("outcome"), F.lit(None).cast("string").alias("reason"), F.concat_ws(",", *cells).alias("record"), "part")
    rejected = read.rejected.select(F.lit("rejected").alias("outcome"), "reason", "record", F.lit(None).cast("int").alias("part"))
    return loaded.unionByName(rejected)


_SQL_CSV_REJECTS = f"""
WITH {_EV},
l AS (SELECT concat_ws(',', coalesce(CAST(event_id AS VARCHAR), ''), coalesce(CAST(user_id AS VARCHAR), '')) AS head,
             coalesce(event_type, '') AS kind, day,
             CASE WHEN user_id % 29 = 0 THEN 'not 4 cells' WHEN user_id % 31 = 0 THEN 'not 4 cells'
                  WHEN user_id % 23 = 0 THEN 'day is no int' END AS reason, user_id
      FROM ev)
SELECT CASE WHEN reason IS NULL THEN 'loaded' ELSE 'rejected' END AS outcome, reason,
       CASE WHEN user_id % 29 = 0 THEN head
            WHEN user_id % 31 = 0 THEN concat_ws(',', head, kind, coalesce(CAST(day AS VARCHAR), ''), 'surplus')
            WHEN user_id % 23 = 0 THEN concat_ws(',', head, kind, 'unknown')
            ELSE concat_ws(',', head, kind, coalesce(CAST(day AS VARCHAR), '')) END AS record,
       CASE WHEN reason IS NULL THEN day END AS part
FROM l
"""


def q_load_sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events landed as one folder per day, listed, and loaded in as many
    write partitions as a rule over the listing says (two per dated folder)."""
    root = shared_scratch(spark, "load-sized")
    ev = events(spark, sf_dir)
    folder = F.concat(F.coalesce(F.col("day").cast("string"), F.lit("undated")), F.lit("-export"))
    ev.withColumn("folder", folder).write.partitionBy("folder").parquet(f"{root}/landing")
    listed = list_input_files(spark, f"{root}/landing")
    rule = 2 * F.count_distinct(F.nullif(date_token(F.col("segment")), F.lit("")))
    batch = spark.read.schema(ev.schema).option("recursiveFileLookup", True).parquet(f"{root}/landing")
    run_load_job(spark, batch, f"{root}/tables", 1, "day", ["event_id"], estimate=estimate_partitions(listed, rule))
    return read_master(spark, f"{root}/tables", ev.schema).drop("batch_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv_headers": q_csv_headers,
    "csv_rejects": q_csv_rejects,
    "load_sized": q_load_sized,
}

ORACLE_SQL: dict[str, str] = {
    "csv_headers": _SQL_CSV_HEADERS,
    "csv_rejects": _SQL_CSV_REJECTS,
    "load_sized": _SQL_STREAM_LOAD,
}
