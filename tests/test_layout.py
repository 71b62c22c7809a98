"""Partition estimators, bucket column, bucket layout, file listing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from increload import (
    bucket_profile,
    estimate_partitions_by_date,
    estimate_partitions_by_files,
    layout_by_bucket,
    list_input_files,
    with_bucket,
)


def _touch(d, names):
    d.mkdir(parents=True, exist_ok=True)
    for n in names:
        (d / n).write_text("a,b\n1,2\n")


def test_estimate_by_files(spark, tmp_path):
    _touch(tmp_path / "sample-files", ["file1", "file2"])
    paths = list_input_files(spark, str(tmp_path / "sample-files"))
    assert estimate_partitions_by_files(paths).first()["estimate"] == 2


def test_estimate_by_date(spark, tmp_path):
    names = [
        "file-20170101-export-01.csv",
        "file-20170101-export-02.csv",
        "file-20170101-export-03.csv",
        "file-20170102-export-01.csv",
        "file-20170102-export-02.csv",
        "file-20170103-export-01.csv",
        "file-20170104-export-01.csv",
    ]
    d = tmp_path / "dated-sample-files"
    _touch(d, names)
    # hidden and marker files are not inputs
    _touch(d, ["_SUCCESS", ".file-20170109-export-01.csv.crc"])
    paths = list_input_files(spark, str(d))
    assert paths.count() == 7
    assert estimate_partitions_by_date(paths, path_col="segment").first()["estimate"] == 4
    assert estimate_partitions_by_files(paths).first()["estimate"] == 7


def test_estimate_by_date_undated_names_share_one_group(spark, tmp_path):
    d = tmp_path / "in"
    _touch(d, ["chunk1.csv", "chunk2.csv", "x-20170101.csv"])
    paths = list_input_files(spark, str(d))
    assert estimate_partitions_by_date(paths, path_col="segment").first()["estimate"] == 2


def test_estimate_uses_first_segment_below_base(spark, tmp_path):
    # digits in the parent folder or in part-file names below a date dir do not count
    base = tmp_path / "20991231"
    _touch(base / "date=20170101", ["part-00000-20201111.parquet", "part-00001.parquet"])
    _touch(base / "date=20170102", ["part-00000.parquet"])
    paths = list_input_files(spark, str(base))
    assert sorted(r[0] for r in paths.select("segment").distinct().collect()) == ["date=20170101", "date=20170102"]
    assert estimate_partitions_by_date(paths, path_col="segment").first()["estimate"] == 2


def test_last_eight_digit_run_wins(spark):
    df = spark.createDataFrame([("a-20170101-20170102.csv",), ("20170102.csv",)], "path string")
    assert estimate_partitions_by_date(df).first()["estimate"] == 1


@pytest.mark.parametrize("dtype", ["int", "double"])
def test_bucket_ids(spark, dtype):
    df = spark.createDataFrame([(1,), (2,), (3,), (3,)], f"x int").select(F.col("x").cast(dtype).alias("x"))
    out = with_bucket(df, "x", 3)
    assert [r["bucket"] for r in out.orderBy("x").collect()] == [1, 2, 0, 0]
    prof = {r["bucket"]: r["n_rows"] for r in bucket_profile(out).collect()}
    assert prof == {0: 2, 1: 1, 2: 1}


def test_bucket_negative_null_and_types(spark):
    df = spark.createDataFrame([(-1,), (None,), (-3,), (5_000_000_000,)], "x long")
    assert [r["bucket"] for r in with_bucket(df, "x", 3).collect()] == [2, 0, 0, 5_000_000_000 % 3]
    d = spark.createDataFrame([(-1.7,), (2.9,)], "x double")
    assert [r["bucket"] for r in with_bucket(d, "x", 3).collect()] == [2, 2]
    with pytest.raises(TypeError):
        with_bucket(spark.createDataFrame([("a",)], "x string"), "x", 3)
    with pytest.raises(ValueError):
        with_bucket(df, "x", 0)


@pytest.mark.parametrize("spread", [1, 4])
def test_layout_by_bucket_places_rows(spark, spread):
    df = spark.createDataFrame([(d, i) for d in range(20170101, 20170108) for i in range(20)], "date int, i int")
    laid = layout_by_bucket(df, "date", 7, spread=spread)
    assert laid.rdd.getNumPartitions() == 7 * spread
    check = with_bucket(laid, "date", 7).withColumn("pid", F.spark_partition_id())
    bad = check.where((F.col("pid") / spread).cast("int") != F.col("bucket")).count()
    assert bad == 0
    # consecutive dates land in distinct buckets
    assert check.select("bucket").distinct().count() == 7
    if spread > 1:
        # one bucket is spread over several partitions
        assert check.where(F.col("bucket") == 0).select("pid").distinct().count() > 1


def test_empty_location_is_rejected(spark, tmp_path):
    from increload import require_partitions

    d = tmp_path / "empty"
    _touch(d, ["_SUCCESS"])
    paths = list_input_files(spark, str(d))
    with pytest.raises(ValueError):
        require_partitions(estimate_partitions_by_files(paths))
    _touch(d, ["20170101.csv"])
    assert require_partitions(estimate_partitions_by_date(list_input_files(spark, str(d)), path_col="segment")) == 1


def test_listing_through_patterns_and_relative_paths(spark, tmp_path, monkeypatch):
    for d in ("in1/date=20170101", "in1/date=20170102", "in2/date=20170101"):
        _touch(tmp_path / d, ["a 1.csv", "_SUCCESS"])
    segments = lambda p: sorted(r["segment"] for r in list_input_files(spark, p).collect())
    assert segments(str(tmp_path / "in*")) == ["date=20170101", "date=20170101", "date=20170102"]
    assert segments(str(tmp_path / "{in1,in2}") + "/") == ["date=20170101", "date=20170101", "date=20170102"]
    assert segments(str(tmp_path / "in[1]" / "date=2017010?")) == ["a 1.csv", "a 1.csv"]
    assert segments(f"file://{tmp_path}//in2") == ["date=20170101"]
    import os

    here = spark.sparkContext._jvm.java.lang.System.getProperty("user.dir")
    assert segments(os.path.relpath(str(tmp_path / "in2"), here)) == ["date=20170101"]


def test_a_path_that_is_not_below_the_base_raises(spark):
    from increload.sources.files import below

    df = spark.createDataFrame([("file:/elsewhere/x.csv",)], "path string")
    with pytest.raises(Exception, match="not below"):
        df.select(below(F.col("path"), "^file:/base/+([^/]+)")).collect()


def test_spread_follows_the_largest_bucket(spark):
    df = spark.createDataFrame([(7, i) for i in range(90)] + [(1, i) for i in range(10)], "date int, i int")
    laid = layout_by_bucket(df, "date", 7, rows_per_partition=20)
    assert laid.rdd.getNumPartitions() == 7 * 5
    assert layout_by_bucket(df, "date", 7).rdd.getNumPartitions() == 7
    assert layout_by_bucket(df.limit(0), "date", 7).rdd.getNumPartitions() == 7


def test_values_that_no_long_holds_go_to_bucket_zero(spark):
    d = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e300,), (4.5,)], "x double")
    assert [r["bucket"] for r in with_bucket(d, "x", 3).collect()] == [0, 0, 0, 1]


def test_estimates_from_bytes_and_by_a_rule_of_ones_own(spark, tmp_path):
    from increload.functions.keys import date_token
    from increload.operators.layout import estimate_partitions, estimate_partitions_by_bytes
    from increload.sources.files import list_input_files

    for name, size in (("20170101-a.csv", 900), ("20170101-b.csv", 200), ("20170102.csv", 50), ("other.csv", 1)):
        (tmp_path / name).write_bytes(b"x" * size)
    listed = list_input_files(spark, str(tmp_path))
    assert {r["segment"]: r["length"] for r in listed.collect()} == {"20170101-a.csv": 900, "20170101-b.csv": 200, "20170102.csv": 50, "other.csv": 1}
    of = lambda df: df.first()["estimate"]
    assert of(estimate_partitions_by_bytes(listed, 400)) == 3 and of(estimate_partitions_by_bytes(listed, 400, growth=2)) == 6
    assert of(estimate_partitions_by_bytes(listed, 1 << 30)) == 1 and of(estimate_partitions_by_bytes(listed.limit(0))) == 0
    assert of(estimate_partitions(listed, F.count_distinct(date_token(F.col("segment"))))) == 3
    assert of(estimate_partitions(listed, F.max("length") / 300)) == 3
    assert of(estimate_partitions(listed.limit(0), F.max("length"))) == 0


def test_write_takes_the_estimated_partitions_by_shares(spark, tmp_path):
    import glob

    from increload import run_load_job
    from increload.operators.antijoin import profile_batch
    from increload.operators.layout import spread_for_write
    from increload.sources import tables

    # a hot value with 80 % of the rows, eight small ones, and null
    part = F.when(F.col("id") % 10 < 8, F.lit(0)).when(F.col("id") % 10 == 9, F.lit(None)).otherwise((F.col("id") / 10 % 8).cast("int") + 1)
    batch = spark.range(20_000).select(part.cast("int").alias("part"), F.col("id").alias("k"))
    counts = profile_batch(batch, "part", ["part", "k"]).counts
    assert sorted(c for _, c in counts)[-1] == 16_000 and sum(c for _, c in counts) == 20_000
    laid = spread_for_write(batch, "part", ["part", "k"], 20, counts)
    plan = laid._jdf.queryExecution().executedPlan().toString()
    assert ", 20), REPARTITION_BY_NUM" in plan and laid.schema == batch.schema
    per = {r["p"]: r["n"] for r in laid.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(per.values()) == 20_000 and max(per.values()) <= 2_200 and len(per) >= 18
    estimate = spark.range(1).select(F.lit(20).alias("estimate"))
    report = run_load_job(spark, batch, str(tmp_path), 1, "part", ["k"], estimate=estimate)
    assert report.n_rows == 20_000
    files = glob.glob(f"{tmp_path}/master/*/*/part=0/*.parquet")
    assert 15 <= len(files) <= 17
    assert len(glob.glob(f"{tmp_path}/master/*/*/*/*.parquet")) <= 20 + 10
    assert tables.read_master(spark, str(tmp_path), batch.schema).exceptAll(batch.withColumn("batch_id", F.lit(1).cast("long"))).isEmpty()
    flat = run_load_job(spark, batch, f"{tmp_path}/flat", 1, None, ["k"], estimate=estimate)
    assert flat.n_rows == 20_000 and len(glob.glob(f"{tmp_path}/flat/master/*/*/*.parquet")) == 20
