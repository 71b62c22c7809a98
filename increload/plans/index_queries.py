"""Queries over large loads and the key index: bucketed index, two passes,
audit of the data's assumptions, reconciliation of an index with its master,
accounts and forecast of a load."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from increload.operators.audit import audit_assumptions
from increload.operators.dedup import dedup_batch
from increload.operators.keyindex import build_key_index
from increload.operators.reconcile import reconcile_index
from increload.operators.sketches import forecast_load, merge_sketches, relative_error, sketch_keys
from increload.plans.catalog import (
    _EV,
    _LI,
    _SQL_DEDUP_ORDERED,
    _SQL_LOAD_EVENTS,
    _SQL_LOAD_PARTITION,
    LINEITEM_KEYS,
    LINEITEM_REST,
    events,
    events_increment,
    lineitem,
    lineitem_increment,
)
from increload.plans.job import run_load_job
from increload.plans.load import incremental_load
from increload.session import shared_scratch
from increload.sources.key_table import KeyTable


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def q_load_bucketed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events loaded against an index that is kept as a bucketed table: the
    days before the split are appended to it, and the batch, too large for a
    broadcast, meets it bucket by bucket."""
    existing, batch = events_increment(spark, sf_dir)
    name = f"increload_keys_{uuid.uuid4().hex}"
    index = KeyTable.open(spark, name, shared_scratch(spark, "key-table"), batch.schema, "day", ["event_id"], _buckets(spark))
    index.append(existing)
    return incremental_load(batch, existing, index, "day", ["event_id"], broadcast_budget=0).delta


def q_load_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem's increment as a batch over the broadcast budget: keys are
    counted and matched first, then whole rows pass without being sorted."""
    existing, batch = lineitem_increment(spark, sf_dir)
    load = incremental_load(batch, existing, None, "y", LINEITEM_KEYS, order_by=LINEITEM_REST, broadcast_budget=1, two_pass=True)
    return load.delta


def q_dedup_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_batch(lineitem(spark, sf_dir), "y", LINEITEM_KEYS, order_by=LINEITEM_REST, two_pass=True)


def q_assumption_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem's increment against the loaded master: keys delivered again
    with another payload, and keys that lie in several years."""
    existing, batch = lineitem_increment(spark, sf_dir)
    return audit_assumptions(batch, "y", LINEITEM_KEYS, existing)


_SQL_ASSUMPTION_AUDIT = f"""
WITH {_LI},
r AS (SELECT *, 1 AS here FROM lbt
      UNION ALL
      SELECT *, 0 AS here FROM lex WHERE EXISTS (
          SELECT 1 FROM lbt b WHERE b.l_orderkey IS NOT DISTINCT FROM lex.l_orderkey
                                AND b.l_linenumber IS NOT DISTINCT FROM lex.l_linenumber)),
p AS (SELECT l_orderkey, l_linenumber, y, sum(here) AS n, count(DISTINCT struct_pack({", ".join(f"c{i} := {c}" for i, c in enumerate(LINEITEM_REST))})) AS payloads
      FROM r GROUP BY ALL),
k AS (SELECT l_orderkey, l_linenumber, CAST(sum(n) AS BIGINT) AS n_rows, count_if(n > 0 AND payloads > 1) AS n_payload_conflicts,
             count(*) AS n_partitions, min(y) AS first_partition, max(y) AS last_partition
      FROM p GROUP BY ALL)
SELECT * FROM k WHERE n_rows > 0 AND (n_payload_conflicts > 0 OR n_partitions > 1)
"""


def q_event_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events against the stored key index, which tells partitions but no
    payloads; events without an id are one key of many days."""
    existing, batch = events_increment(spark, sf_dir)
    return audit_assumptions(batch, "day", ["event_id"], build_key_index(existing, "day", ["event_id"]))


_SQL_EVENT_AUDIT = f"""
WITH {_EV},
r AS (SELECT event_id, day, 1 AS here, struct_pack(a := ts, b := user_id, c := event_type, d := value, e := props) AS payload FROM bt
      UNION ALL
      SELECT DISTINCT event_id, day, 0 AS here, NULL AS payload FROM ex WHERE EXISTS (
          SELECT 1 FROM bt b WHERE b.event_id IS NOT DISTINCT FROM ex.event_id)),
p AS (SELECT event_id, day, sum(here) AS n, count(DISTINCT payload) AS payloads FROM r GROUP BY ALL),
k AS (SELECT event_id, CAST(sum(n) AS BIGINT) AS n_rows, count_if(n > 0 AND payloads > 1) AS n_payload_conflicts,
             count(*) AS n_partitions, min(day) AS first_partition, max(day) AS last_partition
      FROM p GROUP BY ALL)
SELECT * FROM k WHERE n_rows > 0 AND (n_payload_conflicts > 0 OR n_partitions > 1)
"""


def q_index_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' master against an index that went wrong in every fourth
    day: some keys lost, some doubled, some altered."""
    ev = events(spark, sf_dir)
    master = dedup_batch(ev, "day", ["event_id"])
    by = lambda n: F.coalesce(F.pmod("event_id", F.lit(n)) == 0, F.lit(False))
    struck = F.coalesce(F.pmod("day", F.lit(4)) == 0, F.lit(True))
    keys = build_key_index(ev, "day", ["event_id"])
    wrong = keys.where(~(struck & by(19))).withColumn("event_id", F.when(struck & by(17), F.col("event_id") + 1_000_000_000).otherwise(F.col("event_id")))
    wrong = wrong.unionByName(keys.where(struck & by(13) & ~by(17) & ~by(19)))
    path = shared_scratch(spark, "wrong-index")
    wrong.write.partitionBy("day").parquet(path)
    stored = spark.read.schema(wrong.schema).parquet(path)
    return reconcile_index(stored, master, "day", ["event_id"])


_SQL_INDEX_RECONCILE = f"""
WITH {_EV},
k AS (SELECT DISTINCT day, event_id, coalesce(day % 4 = 0, true) AS struck, coalesce(event_id % 13 = 0, false) AS b13,
             coalesce(event_id % 17 = 0, false) AS b17, coalesce(event_id % 19 = 0, false) AS b19 FROM ev),
i AS (SELECT day, CASE WHEN struck AND b17 THEN event_id + 1000000000 ELSE event_id END AS event_id FROM k WHERE NOT (struck AND b19)
      UNION ALL SELECT day, event_id FROM k WHERE struck AND b13 AND NOT b17 AND NOT b19),
c AS (SELECT day, event_id, CAST(sum(m) AS BIGINT) AS n_master, CAST(sum(n) AS BIGINT) AS n_index FROM (
        SELECT day, event_id, 1 AS m, 0 AS n FROM k UNION ALL SELECT day, event_id, 0, 1 FROM i) GROUP BY ALL)
SELECT *, CASE WHEN n_index = 0 THEN 'lost' WHEN n_master = 0 THEN 'foreign' ELSE 'doubled' END AS finding
FROM c WHERE n_index <> 1 OR n_master <> 1
"""


def q_load_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored loads, the second one once more as a batch of its own: what
    each report says became of the rows."""
    base = shared_scratch(spark, "load-accounts")
    existing, batch = events_increment(spark, sf_dir)
    reports = [run_load_job(spark, df, base, i, "day", ["event_id"]) for i, df in enumerate((existing, batch, batch))]
    rows = [(r.batch_id, r.n_input, r.n_null_keys, r.n_copies, r.n_known, r.n_rows) for r in reports]
    return spark.createDataFrame(rows, "batch_id long, n_input long, n_null_keys long, n_copies long, n_known long, n_rows long")


_SQL_LOAD_ACCOUNTS = f"""
WITH {_EV},
b AS (SELECT 0 AS batch_id, day, event_id FROM ex UNION ALL SELECT 1, day, event_id FROM bt UNION ALL SELECT 2, day, event_id FROM bt),
g AS (SELECT batch_id, day, event_id, count(*) AS n FROM b GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY day, event_id ORDER BY batch_id) AS seen FROM g)
SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(sum(n) AS BIGINT) AS n_input, CAST(sum(CASE WHEN event_id IS NULL THEN n ELSE 0 END) AS BIGINT) AS n_null_keys,
       CAST(sum(n - 1) AS BIGINT) AS n_copies, count_if(seen > 1) AS n_known, count_if(seen = 1) AS n_rows
FROM k GROUP BY batch_id
"""


def q_load_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the events' batch will do to each day, from key sketches kept per
    half of the loaded days, next to the counts of the load itself."""
    existing, batch = events_increment(spark, sf_dir)
    halves = [sketch_keys(existing.where(F.pmod("user_id", F.lit(2)) == i), "day", ["event_id"]) for i in (0, 1)]
    loaded = merge_sketches(halves[0].unionByName(halves[1]), "day")
    told = forecast_load(sketch_keys(batch, "day", ["event_id"]), loaded, "day")
    keys = build_key_index(batch, "day", ["event_id"])
    delta = incremental_load(batch, existing, None, "day", ["event_id"]).delta.groupBy(F.col("day").alias("d")).agg(F.count(F.lit(1)).alias("appended"))
    counted = keys.groupBy("day").agg(F.count(F.lit(1)).alias("keys"))
    both = told.join(counted.withColumnRenamed("day", "c"), F.col("day").eqNullSafe(F.col("c"))).join(delta, F.col("day").eqNullSafe(F.col("d")), "left")
    appended = F.coalesce("appended", F.lit(0).cast("long"))
    room = 4 * relative_error() * F.col("keys") + 0.5
    near = (F.abs(F.col("n_keys") - F.col("keys")) <= room) & (F.abs(F.col("n_new") - appended) <= room)
    near = near & (F.abs(F.col("n_known") - (F.col("keys") - appended)) <= room)
    return both.select("day", "n_rows", F.col("keys").alias("n_keys"), appended.alias("n_new"), near.alias("near"))


_SQL_LOAD_FORECAST = f"""
WITH {_EV},
k AS (SELECT day, event_id, count(*) AS n,
             EXISTS (SELECT 1 FROM ex WHERE ex.day IS NOT DISTINCT FROM bt.day AND ex.event_id IS NOT DISTINCT FROM bt.event_id) AS known
      FROM bt GROUP BY ALL)
SELECT day, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, count_if(NOT known) AS n_new, true AS near FROM k GROUP BY day
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "load_bucketed_index": q_load_bucketed_index,
    "load_two_pass": q_load_two_pass,
    "dedup_two_pass": q_dedup_two_pass,
    "assumption_audit": q_assumption_audit,
    "event_audit": q_event_audit,
    "index_reconcile": q_index_reconcile,
    "load_accounts": q_load_accounts,
    "load_forecast": q_load_forecast,
}

ORACLE_SQL: dict[str, str] = {
    "load_bucketed_index": _SQL_LOAD_EVENTS,
    "load_two_pass": _SQL_LOAD_PARTITION,
    "dedup_two_pass": _SQL_DEDUP_ORDERED,
    "assumption_audit": _SQL_ASSUMPTION_AUDIT,
    "event_audit": _SQL_EVENT_AUDIT,
    "index_reconcile": _SQL_INDEX_RECONCILE,
    "load_accounts": _SQL_LOAD_ACCOUNTS,
    "load_forecast": _SQL_LOAD_FORECAST,
}
