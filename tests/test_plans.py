"""Guards on the physical plan: the properties the design relies on at scale."""

from __future__ import annotations

import re

import pytest

from increload import run_load_job
from increload.plans.load import new_rows
from increload.sources import tables

S = "part int, k string, v string"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_load_shuffles_batch_once_and_prunes_stored_keys(spark, tmp_base, no_broadcast):
    b1 = spark.createDataFrame([(d, str(i), "x") for d in range(10) for i in range(50)], S)
    run_load_job(spark, b1, tmp_base, 1, "part", ["k"])
    batch = spark.createDataFrame([(8, str(i), "y") for i in range(80)] + [(11, "1", "z")] * 5, S)
    ks = tables.key_schema_of(batch.schema, "part", ["k"])
    known = tables.existing_keys(spark, tmp_base, ks)
    df = new_rows(batch, known, "part", ["k"], broadcast_budget=0)
    plan = _plan(df)
    # one exchange for the batch (shared by dedup and join), one for the known keys
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    # map-side partial aggregation happens before the batch exchange
    assert "partial_min" in plan
    # the stored index scan is pruned to the batch's partitions and reads keys only
    assert re.search(r"PartitionFilters: \[part#\d+ IN \(8,11\)\]", plan)
    assert "ReadSchema: struct<k:string>" in plan
    assert sorted(r["k"] for r in df.where("part = 8").collect()) == sorted(str(i) for i in range(50, 80))
    assert df.where("part = 11").count() == 1


def test_small_batch_broadcasts_its_keys_instead_of_shuffling_the_index(spark, tmp_base, no_broadcast):
    s = "part int, k long, v string"
    b1 = spark.createDataFrame([(d, i, "x") for d in range(10) for i in range(50)], s)
    run_load_job(spark, b1, tmp_base, 1, "part", ["k"])
    batch = spark.createDataFrame([(8, i, "y") for i in range(80)] + [(11, 1, "z")] * 5, s)
    ks = tables.key_schema_of(batch.schema, "part", ["k"])
    known = tables.existing_keys(spark, tmp_base, ks)
    small = new_rows(batch, known, "part", ["k"])
    plan = _plan(small)
    assert "BroadcastExchange" in plan and "LeftSemi" in plan
    # the index scan feeds the broadcast semi-join directly, not an exchange
    probe_side = plan[plan.index("LeftSemi") : plan.index("BroadcastExchange")]
    assert "FileScan parquet" in probe_side and "Exchange" not in probe_side
    plain = new_rows(batch, known, "part", ["k"], broadcast_budget=0)
    assert "LeftSemi" not in _plan(plain)
    got = sorted(tuple(r) for r in small.collect())
    assert got == sorted(tuple(r) for r in plain.collect())
    assert len(got) == 31


def test_broadcast_bound_and_profile(spark):
    from pyspark.sql import types as T

    from increload.operators.antijoin import key_bytes_bound, profile_batch

    sch = T.StructType(
        [
            T.StructField("d", T.IntegerType()),
            T.StructField("id", T.LongType()),
            T.StructField("s", T.StringType()),
            T.StructField("m", T.DecimalType(30, 2)),
        ]
    )
    assert key_bytes_bound(sch, ["s"], 100) == key_bytes_bound(sch, ["s"]) + 200
    assert key_bytes_bound(T.StructType([T.StructField("a", T.ArrayType(T.LongType()))]), ["a"]) is None
    one, two = key_bytes_bound(sch, ["id"]), key_bytes_bound(sch, ["d", "id"])
    assert 0 < one < two
    assert key_bytes_bound(sch, ["m"]) >= one
    df = spark.createDataFrame([(d, i) for d in range(5) for i in range(d + 1)], "d int, id long")
    prof = profile_batch(df, "d", ["d", "id"])
    assert len(prof.values) == 5 and prof.n_rows == 15 and not prof.has_null
    capped = profile_batch(df, "d", ["d", "id"], max_values=3)
    assert capped.values is None and capped.n_rows == 15 and capped.table.count() == 5
    assert profile_batch(df, None, ["d", "id"]).tag == prof.tag == capped.tag
    texts = df.selectExpr("d", "repeat('é', d) as s", "'xyz' as t")
    assert profile_batch(texts, "d", ["s", "t"]).longest == 2 * 4 + 3


def test_hot_key_in_anti_join_is_split_by_aqe(spark, no_broadcast):
    from pyspark.sql import functions as F

    from increload import anti_join_keys

    confs = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        base = spark.range(0, 9000, numPartitions=8).withColumn("part", F.lit(1))
        # a third of the rows share one key (null)
        batch = base.withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")))
        known = batch.where("id % 5 = 0").select("part", "k")
        out = anti_join_keys(batch, known, "part", ["k"])
        got = sorted(r["id"] for r in out.collect())
        assert "skew=true" in _plan(out)
        assert got == [i for i in range(9000) if i % 3 != 0 and i % 5 != 0]
    finally:
        for k in confs:
            spark.conf.unset(k)


def test_many_partition_values_prune_the_scan_at_run_time(spark, tmp_base):
    from pyspark.sql import functions as F

    from increload.operators.antijoin import DEFAULT_MAX_PRUNE_VALUES, profile_batch

    n = DEFAULT_MAX_PRUNE_VALUES + 200
    known = spark.range(40).select((F.col("id") % 20 * 100).cast("int").alias("part"), F.col("id").cast("string").alias("k"))
    known.write.partitionBy("part").parquet(f"{tmp_base}/keys")
    stored = spark.read.schema("k string, part int").parquet(f"{tmp_base}/keys")
    batch = spark.range(n).select(F.col("id").cast("int").alias("part"), F.lit("none").alias("k"))
    assert profile_batch(batch, "part", ["part", "k"]).values is None
    df = new_rows(batch, stored, "part", ["k"])
    assert df.count() == n
    scan = next(line for line in _plan(df).splitlines() if "FileScan parquet" in line and tmp_base[-12:] in line)
    assert "dynamicpruning" in scan
    batch = spark.range(n).select(F.col("id").cast("int").alias("part"), F.lit("3").alias("k"))
    assert new_rows(batch, stored, "part", ["k"]).count() == n - 1


def test_delta_is_rebalanced_before_it_is_written(spark, tmp_base):
    import glob

    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        batch = spark.range(20_000).select((F.col("id") % 30).cast("int").alias("part"), F.col("id").cast("string").alias("k"))
        run_load_job(spark, batch, tmp_base, 1, "part", ["k"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    files = {a: len(glob.glob(f"{tmp_base}/{a}/*/*/*/*.parquet")) for a in ("master", "index")}
    assert files["master"] <= 60 and files["index"] <= 60
