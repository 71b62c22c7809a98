"""Queries over the driver's tables, each with an equivalent DuckDB SQL oracle.

Every query reads whole tables.  Increments are made the way the loads meet
them in practice: the table is split at a partition value into "already
loaded" and "new", and the last loaded partition is delivered again with the
new one.  All rows of the table are in play on one side or the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from increload.functions.keys import yyyymmdd
from increload.operators.antijoin import anti_join_keys
from increload.operators.dedup import dedup_batch
from increload.operators.keyindex import (
    batch_partitions,
    build_key_index,
    index_profile,
    merge_key_index,
    partition_count,
)
from increload.operators.layout import (
    bucket_profile,
    estimate_partitions_by_date,
    estimate_partitions_by_files,
    require_partitions,
    layout_by_bucket,
    with_bucket,
)
from increload.operators.setops import except_rows, replay_split
from increload.plans.job import run_load_job
from increload.plans.load import incremental_load
from increload.plans.sql_baseline import sql_dedup, sql_dedup_text
from increload.session import shared_scratch
from increload.sources import tables
from increload.sources.files import list_input_files, read_csv_dir, trim_column_names, with_partition_column
from increload.streaming.micro_batch import load_stream

# Fixed split points of the test increments.
EVENTS_SPLIT_DAY = 20240116  # loaded: days before; new: this day on
EVENTS_REPLAY_DAY = 20240115  # delivered again with the new days
YEAR_SPLIT = 1999
YEAR_REPLAY = 1998

LINEITEM_KEYS = ["l_orderkey", "l_linenumber"]
LINEITEM_REST = [
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _redelivered(ev: DataFrame) -> DataFrame:
    """Events as a careless producer delivers them: some without a key, some
    without a day, some twice (with another value)."""
    by = lambda n: F.pmod("user_id", F.lit(n)) == 0
    some = lambda n, c: F.when(F.pmod(F.col("event_id") * 7, F.lit(n)) != 0, F.col(c))
    ev = ev.withColumns({"day": some(41, "day"), "event_id": some(37, "event_id")})
    return ev.unionByName(ev.where(by(3)).withColumn("value", F.col("value") + 1))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redelivered(_read(spark, sf_dir, "events").withColumn("day", yyyymmdd("ts")))


def events_increment(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = events(spark, sf_dir)
    return replay_split(ev, F.col("day") < EVENTS_SPLIT_DAY, F.col("day") == EVENTS_REPLAY_DAY)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate"))


def lineitem_increment(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = lineitem(spark, sf_dir)
    return replay_split(li, F.col("y") < YEAR_SPLIT, F.col("y") == YEAR_REPLAY)


def orders_increment(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = _read(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    return replay_split(o, F.col("y") < YEAR_SPLIT, F.col("y") == YEAR_REPLAY)


# SQL fragments shared by the oracles (DuckDB dialect).
_EV = f"""
e0 AS (SELECT * REPLACE (CASE WHEN event_id * 7 % 37 <> 0 THEN event_id END AS event_id),
              CASE WHEN event_id * 7 % 41 <> 0
                   THEN CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS INTEGER) END AS day
       FROM events),
ev AS (SELECT * FROM e0 UNION ALL SELECT * REPLACE (value + 1 AS value) FROM e0 WHERE user_id % 3 = 0),
ex AS (SELECT * FROM ev WHERE day < {EVENTS_SPLIT_DAY}),
bt AS (SELECT * FROM ev WHERE NOT coalesce(day < {EVENTS_SPLIT_DAY}, false)
       UNION ALL SELECT * FROM ev WHERE day = {EVENTS_REPLAY_DAY})"""

_LI = f"""
li AS (SELECT *, CAST(year(l_shipdate) AS INTEGER) AS y FROM lineitem),
lex AS (SELECT * FROM li WHERE y < {YEAR_SPLIT}),
lbt AS (SELECT * FROM li WHERE NOT coalesce(y < {YEAR_SPLIT}, false)
        UNION ALL SELECT * FROM li WHERE y = {YEAR_REPLAY})"""

_OR = f"""
o AS (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders),
oex AS (SELECT * FROM o WHERE y < {YEAR_SPLIT}),
obt AS (SELECT * FROM o WHERE NOT coalesce(y < {YEAR_SPLIT}, false)
        UNION ALL SELECT * FROM o WHERE y = {YEAR_REPLAY})"""


def _nulls_first(cols: list[str]) -> str:
    return ", ".join(f"{c} ASC NULLS FIRST" for c in cols)


# ---------------------------------------------------------------- loads


def q_load_with_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is stored and read back, as between two runs."""
    existing, batch = events_increment(spark, sf_dir)
    index = build_key_index(existing, "day", ["event_id"])
    path = shared_scratch(spark, "key-index")
    index.write.parquet(path)
    stored = spark.read.schema(index.schema).parquet(path)
    return incremental_load(batch, existing, stored, "day", ["event_id"]).delta


def q_load_index_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, batch = events_increment(spark, sf_dir)
    return incremental_load(batch, existing, None, "day", ["event_id"]).delta


_SQL_LOAD_EVENTS = f"""
WITH {_EV},
dd AS (SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY day, event_id
                                     ORDER BY {_nulls_first(['ts', 'user_id', 'event_type', 'value', 'props'])}) AS rn
        FROM bt) WHERE rn = 1)
SELECT * FROM dd WHERE NOT EXISTS (
    SELECT 1 FROM ex WHERE ex.day IS NOT DISTINCT FROM dd.day AND ex.event_id IS NOT DISTINCT FROM dd.event_id)
"""


def q_load_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return incremental_load(docs, None, None, "lang", ["text"], order_by=["doc_id"]).delta


_SQL_LOAD_FIRST = f"""
SELECT doc_id, text, lang, source, n_chars FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, text
                                 ORDER BY {_nulls_first(['doc_id', 'source', 'n_chars'])}) AS rn
    FROM documents) WHERE rn = 1
"""


def q_load_global_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, batch = lineitem_increment(spark, sf_dir)
    order = [*LINEITEM_REST, "y"]
    return incremental_load(batch, existing, None, "y", LINEITEM_KEYS, order_by=order, scope="global").delta


_SQL_LOAD_GLOBAL = f"""
WITH {_LI},
dd AS (SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                     ORDER BY {_nulls_first([*LINEITEM_REST, 'y'])}) AS rn
        FROM lbt) WHERE rn = 1)
SELECT * FROM dd WHERE NOT EXISTS (
    SELECT 1 FROM lex WHERE lex.l_orderkey IS NOT DISTINCT FROM dd.l_orderkey
                        AND lex.l_linenumber IS NOT DISTINCT FROM dd.l_linenumber)
"""


def q_load_partition_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, batch = lineitem_increment(spark, sf_dir)
    return incremental_load(batch, existing, None, "y", LINEITEM_KEYS, order_by=LINEITEM_REST).delta


_SQL_LOAD_PARTITION = f"""
WITH {_LI},
dd AS (SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY y, l_orderkey, l_linenumber
                                     ORDER BY {_nulls_first(LINEITEM_REST)}) AS rn
        FROM lbt) WHERE rn = 1)
SELECT * FROM dd WHERE NOT EXISTS (
    SELECT 1 FROM lex WHERE lex.y IS NOT DISTINCT FROM dd.y
                        AND lex.l_orderkey IS NOT DISTINCT FROM dd.l_orderkey
                        AND lex.l_linenumber IS NOT DISTINCT FROM dd.l_linenumber)
"""


def q_load_unpartitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First load of web pages with no partition column, keyed by the whole page."""
    pages = _read(spark, sf_dir, "pages")
    return incremental_load(pages, None, None, None, ["html"], order_by=["page_id"]).delta


_SQL_LOAD_UNPARTITIONED = f"""
SELECT page_id, url, html FROM (
    SELECT *, row_number() OVER (PARTITION BY html ORDER BY {_nulls_first(['page_id', 'url'])}) AS rn
    FROM pages) WHERE rn = 1
"""


# ---------------------------------------------------------------- dedup


def q_dedup_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_batch(lineitem(spark, sf_dir), "y", LINEITEM_KEYS, order_by=LINEITEM_REST)


_SQL_DEDUP_ORDERED = f"""
WITH {_LI}
SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY y, l_orderkey, l_linenumber
                                 ORDER BY {_nulls_first(LINEITEM_REST)}) AS rn
    FROM li) WHERE rn = 1
"""


def q_dedup_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key holds a large share of the table (a handful of flag pairs):
    the partial aggregate collapses each key inside every map task, so no
    reducer receives a hot key's rows."""
    li = _read(spark, sf_dir, "lineitem")
    rest = [c for c in li.columns if c not in ("l_returnflag", "l_linestatus")]
    return dedup_batch(li, None, ["l_returnflag", "l_linestatus"], order_by=rest)


_SQL_DEDUP_HOT = """
SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus
                                 ORDER BY l_orderkey NULLS FIRST, l_partkey NULLS FIRST, l_suppkey NULLS FIRST,
                                          l_linenumber NULLS FIRST, l_quantity NULLS FIRST,
                                          l_extendedprice NULLS FIRST, l_discount NULLS FIRST, l_tax NULLS FIRST,
                                          l_shipdate NULLS FIRST) AS rn
    FROM lineitem) WHERE rn = 1
"""


def q_dedup_any_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_batch(lineitem(spark, sf_dir), "y", LINEITEM_KEYS).select("y", *LINEITEM_KEYS)


_SQL_DEDUP_ANY = f"""
WITH {_LI}
SELECT DISTINCT y, l_orderkey, l_linenumber FROM li
"""


# ---------------------------------------------------------------- key index

EVENT_KEYS = ["user_id", "event_type"]


def q_key_index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_key_index(events(spark, sf_dir), "day", EVENT_KEYS)


_SQL_INDEX_BUILD = f"""
WITH {_EV}
SELECT DISTINCT day, user_id, event_type FROM ev
"""


def _merged_event_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, batch = events_increment(spark, sf_dir)
    return merge_key_index(build_key_index(existing, "day", EVENT_KEYS), build_key_index(batch, "day", EVENT_KEYS))


def q_key_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged_event_index(spark, sf_dir)


_SQL_INDEX_MERGE = f"""
WITH {_EV}
SELECT day, user_id, event_type FROM ex
UNION
SELECT day, user_id, event_type FROM bt
"""


def q_index_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_profile(_merged_event_index(spark, sf_dir), "day", EVENT_KEYS)


_SQL_INDEX_PROFILE = f"""
WITH {_EV},
idx AS (SELECT day, user_id, event_type FROM ex UNION SELECT day, user_id, event_type FROM bt)
SELECT day, n_keys, user_id AS min_user_id, event_type AS min_event_type FROM (
    SELECT *, count(*) OVER (PARTITION BY day) AS n_keys,
           row_number() OVER (PARTITION BY day ORDER BY {_nulls_first(EVENT_KEYS)}) AS rn
    FROM idx) WHERE rn = 1
"""


def q_index_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit rows derived from events: every day is a data batch; the days
    before the split also have their index committed."""
    ev = events(spark, sf_dir)
    data = ev.groupBy(F.col("day").cast("long").alias("batch_id")).agg(F.count(F.lit(1)).alias("n"))
    data = data.withColumn("stage", F.lit("data"))
    idx = (
        ev.where(F.col("day") < EVENTS_SPLIT_DAY)
        .groupBy(F.col("day").cast("long").alias("batch_id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("stage", F.lit("index"))
    )
    return tables.coverage_of(data.unionByName(idx))


_SQL_INDEX_COVERAGE = f"""
WITH {_EV},
d AS (SELECT CAST(day AS BIGINT) AS batch_id, count(*) AS n_rows FROM ev GROUP BY day),
i AS (SELECT DISTINCT CAST(day AS BIGINT) AS batch_id FROM ev WHERE day < {EVENTS_SPLIT_DAY})
SELECT d.batch_id, d.n_rows, i.batch_id IS NOT NULL AS has_index FROM d LEFT JOIN i ON d.batch_id = i.batch_id
"""


# ---------------------------------------------------------------- anti-joins


def q_anti_join_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, batch = events_increment(spark, sf_dir)
    k = F.nullif(F.col("user_id") % 7, F.lit(0))
    return anti_join_keys(batch.withColumn("k", k), existing.withColumn("k", k), "day", ["k"])


_SQL_ANTI_NULL = f"""
WITH {_EV},
exk AS (SELECT *, nullif(user_id % 7, 0) AS k FROM ex),
btk AS (SELECT *, nullif(user_id % 7, 0) AS k FROM bt)
SELECT * FROM btk WHERE NOT EXISTS (
    SELECT 1 FROM exk WHERE exk.day IS NOT DISTINCT FROM btk.day AND exk.k IS NOT DISTINCT FROM btk.k)
"""


def q_anti_join_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, batch = events_increment(spark, sf_dir)
    return anti_join_keys(batch, existing, "day", ["user_id", "props"], scope="global")


_SQL_ANTI_GLOBAL = f"""
WITH {_EV}
SELECT * FROM bt WHERE NOT EXISTS (
    SELECT 1 FROM ex WHERE ex.user_id IS NOT DISTINCT FROM bt.user_id
                       AND ex.props IS NOT DISTINCT FROM bt.props)
"""


# ---------------------------------------------------------------- SQL baseline


def q_sql_dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, batch = events_increment(spark, sf_dir)
    return sql_dedup(batch, existing, "day", EVENT_KEYS, ["value", "props"], output="counts")


def q_sql_dedup_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, batch = events_increment(spark, sf_dir)
    return sql_dedup(batch, existing, "day", EVENT_KEYS, output="one")


def q_sql_join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, batch = events_increment(spark, sf_dir)
    return sql_dedup_text(batch, existing, "day", EVENT_KEYS, ["value", "props"], output="counts")


def q_sql_join_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, batch = events_increment(spark, sf_dir)
    return sql_dedup_text(batch, existing, "day", EVENT_KEYS, output="one")


_SQL_BASELINE_KEPT = f"""
WITH {_EV},
rt AS (SELECT DISTINCT user_id, event_type FROM ex
       WHERE EXISTS (SELECT 1 FROM bt WHERE bt.day IS NOT DISTINCT FROM ex.day)
         AND NOT (user_id IS NULL AND event_type IS NULL)),
kept AS (SELECT * FROM bt WHERE NOT EXISTS (
    SELECT 1 FROM rt WHERE rt.user_id IS NOT DISTINCT FROM bt.user_id
                       AND rt.event_type IS NOT DISTINCT FROM bt.event_type))"""

_SQL_BASELINE_COUNTS = f"""{_SQL_BASELINE_KEPT}
SELECT user_id, event_type, day, count(value) AS n_value, count(props) AS n_props
FROM kept GROUP BY user_id, event_type, day
"""

_SQL_BASELINE_ONE = f"""{_SQL_BASELINE_KEPT}
SELECT user_id, event_type, day, event_id, ts, value, props FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type, day
                                 ORDER BY {_nulls_first(['event_id', 'ts', 'value', 'props'])}) AS rn
    FROM kept) WHERE rn = 1
"""


# ---------------------------------------------------------------- partitions, splits


def q_batch_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_partitions(events(spark, sf_dir), "day")


_SQL_BATCH_PARTITIONS = f"""
WITH {_EV}
SELECT DISTINCT day FROM ev
"""


def q_partition_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_count(events(spark, sf_dir), "day")


_SQL_PARTITION_COUNT = f"""
WITH {_EV}
SELECT count(*) AS n_partitions FROM (SELECT DISTINCT day FROM ev)
"""


def q_replay_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_increment(spark, sf_dir)[1]


_SQL_REPLAY_SPLIT = f"""
WITH {_OR}
SELECT * FROM obt
"""


def q_except_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, batch = orders_increment(spark, sf_dir)
    return except_rows(batch, existing)


_SQL_EXCEPT_ROWS = f"""
WITH {_OR}
SELECT * FROM obt EXCEPT SELECT * FROM oex
"""


# ---------------------------------------------------------------- layout


def _orders_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (-F.col("o_custkey")).alias("neg_custkey"))
    return with_bucket(o, "neg_custkey", 7)


def q_with_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_bucketed(spark, sf_dir)


_SQL_WITH_BUCKET = """
SELECT o_orderkey, o_custkey, -o_custkey AS neg_custkey,
       CAST(coalesce(((-o_custkey % 7) + 7) % 7, 0) AS INTEGER) AS bucket
FROM orders
"""


def q_bucket_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_profile(_orders_bucketed(spark, sf_dir), "bucket")


_SQL_BUCKET_PROFILE = """
SELECT CAST(coalesce(((-o_custkey % 7) + 7) % 7, 0) AS INTEGER) AS bucket, count(*) AS n_rows
FROM orders GROUP BY 1
"""


def q_layout_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders laid out by bucket of their order day (7 buckets, each spread
    over 4 partitions); ``placed_bucket`` is read back from the partition id."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", yyyymmdd("o_orderdate").alias("day"))
    laid = with_bucket(layout_by_bucket(o, "day", 7, spread=4), "day", 7)
    return laid.select("o_orderkey", "day", "bucket", (F.spark_partition_id() / 4).cast("int").alias("placed_bucket"))


_SQL_LAYOUT = """
SELECT o_orderkey, day, CAST(day % 7 AS INTEGER) AS bucket, CAST(day % 7 AS INTEGER) AS placed_bucket
FROM (SELECT o_orderkey, CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INTEGER) AS day
      FROM orders)
"""


def _event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing-file names an hourly export of events would have; errors land
    in one undated file."""
    ev = _read(spark, sf_dir, "events")
    dated = F.concat(
        F.lit("landing/events/"),
        F.date_format("ts", "yyyyMMdd"),
        F.lit("-export-"),
        F.lpad(F.hour("ts").cast("string"), 2, "0"),
        F.lit(".csv"),
    )
    path = F.when(F.col("event_type") == "error", F.lit("landing/events/unsorted.csv")).otherwise(dated)
    return ev.select(path.alias("path"))


_SQL_EVENT_PATHS = """
p AS (SELECT CASE WHEN event_type = 'error' THEN 'landing/events/unsorted.csv'
             ELSE 'landing/events/' || strftime(ts, '%Y%m%d') || '-export-'
                  || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || '.csv' END AS path
      FROM events)"""


def q_estimate_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate_partitions_by_date(_event_paths(spark, sf_dir), base="landing/events")


_SQL_ESTIMATE_DATE = f"""
WITH {_SQL_EVENT_PATHS}
SELECT count(DISTINCT regexp_extract(path, '^.*(\\d{{8}}).*$', 1)) AS estimate FROM p
"""


def q_estimate_by_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate_partitions_by_files(_event_paths(spark, sf_dir))


_SQL_ESTIMATE_FILES = f"""
WITH {_SQL_EVENT_PATHS}
SELECT count(DISTINCT path) AS estimate FROM p
"""


# ---------------------------------------------------------------- stored tables


def _two_loads(spark: SparkSession, sf_dir: str) -> str:
    base = shared_scratch(spark, "load-job")
    existing, batch = events_increment(spark, sf_dir)
    run_load_job(spark, existing, base, 1, "day", ["event_id"])
    run_load_job(spark, batch, base, 2, "day", ["event_id"])
    return base


def q_run_load_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored loads; the rows the second one appended."""
    base = _two_loads(spark, sf_dir)
    schema = events(spark, sf_dir).schema
    return tables.read_master(spark, base, schema, batch_ids=[2])


_SQL_RUN_LOAD_JOB = f"""
SELECT *, CAST(2 AS BIGINT) AS batch_id FROM ({_SQL_LOAD_EVENTS})
"""


def q_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored loads; the key index as stored, with its batch ids."""
    base = _two_loads(spark, sf_dir)
    schema = tables.key_schema_of(events(spark, sf_dir).schema, "day", ["event_id"])
    return tables.read_key_index(spark, base, schema)


_SQL_STORED_INDEX = f"""
WITH {_EV}
SELECT DISTINCT day, event_id, CAST(CASE WHEN day < {EVENTS_SPLIT_DAY} THEN 1 ELSE 2 END AS BIGINT) AS batch_id FROM ev
"""


def q_compacted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored loads, then the per-batch indexes merged into one; the
    index as read after the merge."""
    base = _two_loads(spark, sf_dir)
    schema = tables.key_schema_of(events(spark, sf_dir).schema, "day", ["event_id"])
    tables.compact_key_index(spark, base, schema, "day")
    return tables.read_key_index(spark, base, schema)


def q_compacted_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored loads, index and master merged into segments, a third load
    of everything again (which appends nothing), and a second merge; the
    master table afterwards."""
    base = _two_loads(spark, sf_dir)
    ev = events(spark, sf_dir)
    tables.compact_key_index(spark, base, tables.key_schema_of(ev.schema, "day", ["event_id"]), "day")
    tables.compact_master(spark, base, ev.schema, "day")
    run_load_job(spark, ev, base, 3, "day", ["event_id"])
    tables.compact_master(spark, base, ev.schema, "day", full=True)
    return tables.read_master(spark, base, ev.schema)


_SQL_COMPACTED_MASTER = f"""
WITH {_EV},
dd AS (SELECT *, 1 AS b FROM ex UNION ALL SELECT *, 2 AS b FROM bt)
SELECT * EXCLUDE (rn, b), CAST(b AS BIGINT) AS batch_id FROM (
    SELECT *, row_number() OVER (PARTITION BY day, event_id ORDER BY b,
                                 {_nulls_first(['ts', 'user_id', 'event_type', 'value', 'props'])}) AS rn
    FROM dd) WHERE rn = 1
"""


def q_load_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load, a second one whose first attempt dies after writing half of its
    rows, its retry, the retry's own retry, and the batch delivered again
    under a new id; the master table afterwards."""
    base = shared_scratch(spark, "load-retry")
    existing, batch = events_increment(spark, sf_dir)
    run_load_job(spark, existing, base, 1, "day", ["event_id"])
    tables.append_delta(batch.where("user_id % 2 = 0"), base, 2, "day", tables.new_attempt())
    run_load_job(spark, batch, base, 2, "day", ["event_id"])
    run_load_job(spark, batch, base, 2, "day", ["event_id"])
    run_load_job(spark, batch, base, 3, "day", ["event_id"])
    return tables.read_master(spark, base, batch.schema)


def q_load_many_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders loaded by order day: more partition values than become literals."""
    o = _read(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    existing, batch = replay_split(o, F.pmod("o_orderkey", F.lit(3)) != 0, F.pmod("o_orderkey", F.lit(5)) == 0)
    return incremental_load(batch, existing, build_key_index(existing, "d", ["o_orderkey"]), "d", ["o_orderkey"]).delta


_SQL_LOAD_MANY = """
SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders WHERE coalesce(o_orderkey % 3 = 0, true)
"""


def q_csv_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members-style CSV drop: header names padded with blanks, every value
    text; the partition column is cast from one of them."""
    base = shared_scratch(spark, "csv-demo")
    existing, batch = events_increment(spark, sf_dir)

    def drop_csv(df: DataFrame, name: str) -> None:
        cols = df.columns
        # text forms that read the same everywhere
        df = df.withColumns({"ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "value": F.col("value").cast("decimal(20,4)")})
        out = df.select(*[F.col(c).cast("string").alias(c if i == 0 else f" {c}") for i, c in enumerate(cols)])
        out.write.mode("overwrite").option("header", True).csv(f"{base}/{name}")

    drop_csv(existing, "already_loaded")
    drop_csv(batch, "new_increment")
    old = with_partition_column(trim_column_names(read_csv_dir(spark, f"{base}/already_loaded")), "part", "day")
    new = with_partition_column(trim_column_names(read_csv_dir(spark, f"{base}/new_increment")), "part", "day")
    return incremental_load(new, old, None, "part", ["event_id"]).delta


_SQL_LOAD_TEXT_EVENTS = _SQL_LOAD_EVENTS.replace("user_id ASC", "CAST(user_id AS VARCHAR) ASC").replace(
    "value ASC", "CAST(CAST(value AS DECIMAL(20,4)) AS VARCHAR) ASC"
)

# The rows are text when they are de-duplicated, so text order decides.
_SQL_CSV_DEMO = f"""
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, props,
       strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, CAST(CAST(value AS DECIMAL(20,4)) AS VARCHAR) AS value,
       CAST(day AS VARCHAR) AS day, day AS part
FROM ({_SQL_LOAD_TEXT_EVENTS})
"""


def _drop_and_run(spark: SparkSession, df: DataFrame, root: str, name: str, compact_every: int) -> None:
    """Deliver ``df`` as one file drop and let the stream load what is new,
    in one micro-batch."""
    df.write.parquet(f"{root}/landing/drop={name}")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{root}/landing")
    q = load_stream(
        stream, f"{root}/tables", "day", ["event_id"], f"{root}/checkpoint", trigger={"availableNow": True}, compact_every=compact_every
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def q_stream_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events delivered as three file drops (first half, second half, second
    half again) and loaded by a streaming query, restarted for each; the
    master table afterwards."""
    ev = events(spark, sf_dir)
    root = shared_scratch(spark, "stream-load")
    early = F.col("day") < EVENTS_SPLIT_DAY
    late = ~early | early.isNull()
    for i, cond in enumerate([early, late, late]):
        _drop_and_run(spark, ev.where(cond), root, str(i), compact_every=0)
    return tables.read_master(spark, f"{root}/tables", ev.schema).drop("batch_id")


_SQL_STREAM_LOAD = f"""
WITH {_EV}
SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY day, event_id
                                 ORDER BY {_nulls_first(['ts', 'user_id', 'event_type', 'value', 'props'])}) AS rn
    FROM ev) WHERE rn = 1
"""


def q_stream_after_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream loads the first days, a job loads one day under a high id, all
    is compacted, and the stream goes on with the rest; the master table
    afterwards."""
    ev = events(spark, sf_dir)
    root = shared_scratch(spark, "stream-compaction")
    base = f"{root}/tables"
    early, replayed = F.col("day") < EVENTS_REPLAY_DAY, F.col("day") == EVENTS_REPLAY_DAY
    _drop_and_run(spark, ev.where(early), root, "first", compact_every=1)
    run_load_job(spark, ev.where(replayed), base, 2_000_000, "day", ["event_id"])
    tables.compact_key_index(spark, base, tables.key_schema_of(ev.schema, "day", ["event_id"]), "day", full=True)
    _drop_and_run(spark, ev.where(~early | early.isNull()), root, "rest", compact_every=1)
    return tables.read_master(spark, base, ev.schema).drop("batch_id")


def q_estimate_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as one landing directory per day, listed, and estimated
    by date and by directory; the load's guard accepts the first."""
    path = shared_scratch(spark, "landing-files")
    ev = events(spark, sf_dir)
    dated = ev.withColumn("file", F.concat(F.coalesce(F.col("day").cast("string"), F.lit("undated")), F.lit("-export")))
    dated.select("file", "user_id").write.partitionBy("file").parquet(path)
    listed = list_input_files(spark, path)
    by_date = estimate_partitions_by_date(listed.select(F.col("segment").alias("path")))
    require_partitions(by_date)
    names = listed.select(F.col("segment").alias("path"))
    return by_date.select(F.lit("date").alias("kind"), "estimate").unionByName(
        estimate_partitions_by_files(names).select(F.lit("files").alias("kind"), "estimate")
    )


_SQL_ESTIMATE_LANDING = f"""
WITH {_EV}
SELECT kind, count(DISTINCT coalesce(day, -1)) AS estimate
FROM ev CROSS JOIN (VALUES ('date'), ('files')) AS k(kind) GROUP BY kind
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "load_with_index": q_load_with_index,
    "load_index_lost": q_load_index_lost,
    "load_first": q_load_first,
    "load_global_scope": q_load_global_scope,
    "load_partition_scope": q_load_partition_scope,
    "load_unpartitioned": q_load_unpartitioned,
    "dedup_ordered": q_dedup_ordered,
    "dedup_any_keys": q_dedup_any_keys,
    "dedup_hot_keys": q_dedup_hot_keys,
    "key_index_build": q_key_index_build,
    "key_index_merge": q_key_index_merge,
    "index_profile": q_index_profile,
    "index_coverage": q_index_coverage,
    "anti_join_null_keys": q_anti_join_null_keys,
    "anti_join_global": q_anti_join_global,
    "sql_dedup_counts": q_sql_dedup_counts,
    "sql_dedup_one": q_sql_dedup_one,
    "sql_join_counts": q_sql_join_counts,
    "sql_join_one": q_sql_join_one,
    "batch_partitions": q_batch_partitions,
    "partition_count": q_partition_count,
    "replay_split": q_replay_split,
    "except_rows": q_except_rows,
    "with_bucket": q_with_bucket,
    "bucket_profile": q_bucket_profile,
    "layout_by_bucket": q_layout_by_bucket,
    "estimate_by_date": q_estimate_by_date,
    "estimate_by_files": q_estimate_by_files,
    "run_load_job": q_run_load_job,
    "stored_index": q_stored_index,
    "compacted_index": q_compacted_index,
    "csv_demo": q_csv_demo,
    "stream_load": q_stream_load,
    "load_retry": q_load_retry,
    "load_many_partitions": q_load_many_partitions,
    "compacted_master": q_compacted_master,
    "stream_after_compaction": q_stream_after_compaction,
    "estimate_landing": q_estimate_landing,
}

ORACLE_SQL: dict[str, str] = {
    "load_with_index": _SQL_LOAD_EVENTS,
    "load_index_lost": _SQL_LOAD_EVENTS,
    "load_first": _SQL_LOAD_FIRST,
    "load_global_scope": _SQL_LOAD_GLOBAL,
    "load_partition_scope": _SQL_LOAD_PARTITION,
    "load_unpartitioned": _SQL_LOAD_UNPARTITIONED,
    "dedup_ordered": _SQL_DEDUP_ORDERED,
    "dedup_any_keys": _SQL_DEDUP_ANY,
    "dedup_hot_keys": _SQL_DEDUP_HOT,
    "key_index_build": _SQL_INDEX_BUILD,
    "key_index_merge": _SQL_INDEX_MERGE,
    "index_profile": _SQL_INDEX_PROFILE,
    "index_coverage": _SQL_INDEX_COVERAGE,
    "anti_join_null_keys": _SQL_ANTI_NULL,
    "anti_join_global": _SQL_ANTI_GLOBAL,
    "sql_dedup_counts": _SQL_BASELINE_COUNTS,
    "sql_dedup_one": _SQL_BASELINE_ONE,
    "sql_join_counts": _SQL_BASELINE_COUNTS,
    "sql_join_one": _SQL_BASELINE_ONE,
    "batch_partitions": _SQL_BATCH_PARTITIONS,
    "partition_count": _SQL_PARTITION_COUNT,
    "replay_split": _SQL_REPLAY_SPLIT,
    "except_rows": _SQL_EXCEPT_ROWS,
    "with_bucket": _SQL_WITH_BUCKET,
    "bucket_profile": _SQL_BUCKET_PROFILE,
    "layout_by_bucket": _SQL_LAYOUT,
    "estimate_by_date": _SQL_ESTIMATE_DATE,
    "estimate_by_files": _SQL_ESTIMATE_FILES,
    "run_load_job": _SQL_RUN_LOAD_JOB,
    "stored_index": _SQL_STORED_INDEX,
    "compacted_index": _SQL_STORED_INDEX,
    "csv_demo": _SQL_CSV_DEMO,
    "stream_load": _SQL_STREAM_LOAD,
    "load_retry": _SQL_COMPACTED_MASTER,
    "load_many_partitions": _SQL_LOAD_MANY,
    "compacted_master": _SQL_COMPACTED_MASTER,
    "stream_after_compaction": _SQL_STREAM_LOAD,
    "estimate_landing": _SQL_ESTIMATE_LANDING,
}
