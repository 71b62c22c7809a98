"""Micro-batch loads from a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from increload import compact_key_index, dedup_batch, read_master, run_load_job
from increload.functions.keys import yyyymmdd
from increload.plans.job import STREAM_IDS
from increload.sources import tables
from increload.streaming import load_stream
from increload.streaming.micro_batch import stream_number

SF = "/root/testdata/sf0.001"


def test_stream_loads_each_file_once(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("day", yyyymmdd("ts"))
    src = tmp_path / "landing"
    # three deliveries: two halves, then the second half again
    first = events.where(F.col("day") < 20240116)
    second = events.where(F.col("day") >= 20240116)
    for i, part in enumerate([first, second, second]):
        part.coalesce(1).write.parquet(str(src / f"drop{i}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    base = str(tmp_path / "tables")
    q = load_stream(stream, base, "day", ["event_id"], str(tmp_path / "ckpt"), trigger={"availableNow": True})
    q.awaitTermination(300)
    master = read_master(spark, base, events.schema)
    assert master.count() == dedup_batch(events, "day", ["event_id"]).count()
    assert master.select("day", "event_id").distinct().count() == master.count()
    ids = sorted(r[0] for r in master.select("batch_id").distinct().collect())
    assert ids == [STREAM_IDS, STREAM_IDS + 1]


def test_streams_have_ids_of_their_own(spark, tmp_path):
    base, ck = str(tmp_path / "tables"), str(tmp_path / "ckpt")
    assert stream_number(spark, base, ck) == 1
    # same checkpoint: same number, whatever came since
    assert stream_number(spark, base, str(tmp_path / "other")) == 2
    assert stream_number(spark, base, ck + "/") == 1


def test_stream_goes_on_after_a_job_and_a_compaction(spark, tmp_path):
    """Epochs are skipped only when the commit log holds them, never by the order of ids."""
    base, ck, src = (str(tmp_path / n) for n in ("tables", "ckpt", "landing"))
    s = "part int, k long"

    def drop_and_run(ids, name):
        spark.createDataFrame([(1, i) for i in ids], s).coalesce(1).write.parquet(f"{src}/{name}")
        stream = spark.readStream.schema(s).parquet(f"{src}/*")
        load_stream(stream, base, "part", ["k"], ck, trigger={"availableNow": True}).awaitTermination(300)

    drop_and_run([0, 1, 2], "a")
    job = spark.createDataFrame([(1, i) for i in (50, 51, 52)], s)
    run_load_job(spark, job, base, 20, "part", ["k"])
    compact_key_index(spark, base, tables.key_schema_of(job.schema, "part", ["k"]), "part")
    drop_and_run([3, 4, 5, 0], "b")
    master = read_master(spark, base, job.schema)
    assert sorted(r["k"] for r in master.collect()) == [0, 1, 2, 3, 4, 5, 50, 51, 52]


def test_stream_compacts_as_it_goes(spark, tmp_path):
    base, src = str(tmp_path / "tables"), str(tmp_path / "landing")
    s = "part int, k long"
    for i in range(7):
        spark.createDataFrame([(1, i), (2, i)], s).coalesce(1).write.parquet(f"{src}/{i}")
    stream = spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = load_stream(stream, base, "part", ["k"], str(tmp_path / "ck"), trigger={"availableNow": True}, compact_every=2)
    q.awaitTermination(300)
    state = tables.read_state(spark, base)
    # two batches a segment; the third compaction folds the first two segments in
    assert len(state.batches) == 1 and len(state.index_segments) == len(state.data_segments) == 1
    assert read_master(spark, base, spark.createDataFrame([], s).schema).count() == 14


def test_replayed_epoch_lands_once(spark, tmp_path):
    import os

    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("day", yyyymmdd("ts"))
    src = tmp_path / "landing"
    events.coalesce(1).write.parquet(str(src / "drop0"))
    stream = spark.readStream.schema(events.schema).parquet(str(src / "*"))
    base, ck = str(tmp_path / "tables"), str(tmp_path / "ckpt")
    load_stream(stream, base, "day", ["event_id"], ck, trigger={"availableNow": True}).awaitTermination(300)
    assert read_master(spark, base, events.schema).count() == events.count()
    # the job loaded epoch 0 but "died" before the stream recorded it: the
    # restarted query runs epoch 0 again, under the same batch id
    for name in ("0", ".0.crc"):
        if os.path.exists(os.path.join(ck, "commits", name)):
            os.remove(os.path.join(ck, "commits", name))
    load_stream(stream, base, "day", ["event_id"], ck, trigger={"availableNow": True}).awaitTermination(300)
    master = read_master(spark, base, events.schema)
    assert master.count() == events.count()
    assert [r[0] for r in master.select("batch_id").distinct().collect()] == [STREAM_IDS]
