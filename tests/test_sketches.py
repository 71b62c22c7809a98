"""Sketches of keys, point look-ups in the key table, the filter before a stream."""

from __future__ import annotations

import glob
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from increload.operators.sketches import forecast_load, key_counts, merge_sketches, relative_error, size_quantiles, sketch_keys
from increload.plans.load import new_rows
from increload.sources import tables
from increload.sources.key_table import KeyTable
from increload.streaming.micro_batch import load_stream

S = "part int, k string"


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("part", ["part", None])
def test_small_sketches_are_exact(spark, part):
    rng = random.Random(3)
    row = lambda: (rng.choice([1, 2, None]), rng.choice(["a", "b", "c", "d", None]))
    old, new = [row() for _ in range(12)], [row() for _ in range(20)]
    keys = ["k"] if part else ["part", "k"]
    halves = [sketch_keys(spark.createDataFrame(old[i::2], S), part, keys) for i in (0, 1)]
    loaded = merge_sketches(halves[0].unionByName(halves[1]), part)
    place = (lambda r: r[0]) if part else (lambda r: 0)
    by = {p: {r for r in old if place(r) == p} for p in map(place, old)}
    told = lambda df: {tuple(r) if part else (0, *r) for r in df.collect()}
    assert told(key_counts(loaded, part)) == {(p, sum(place(r) == p for r in old), len(s)) for p, s in by.items()}
    want = set()
    for p in set(map(place, new)):
        here = {r for r in new if place(r) == p}
        known = here & by.get(p, set())
        want.add((p, sum(place(r) == p for r in new), len(here), len(known), len(here) - len(known)))
    assert told(forecast_load(sketch_keys(spark.createDataFrame(new, S), part, keys), loaded, part)) == want


def test_large_sketches_stay_within_their_error(spark):
    old = spark.range(200_000).select(F.lit(1).alias("part"), F.col("id").alias("k"))
    new = spark.range(150_000, 300_000).select(F.lit(1).alias("part"), F.col("id").alias("k"))
    r = forecast_load(sketch_keys(new.unionByName(new), "part", ["k"], lg=12), sketch_keys(old, "part", ["k"], lg=12), "part").first()
    room = 4 * relative_error(12) * 300_000
    assert r["n_rows"] == 300_000 and abs(r["n_keys"] - 150_000) < room and abs(r["n_known"] - 50_000) < room and abs(r["n_new"] - 100_000) < room
    sizes = spark.range(1000).select((F.sqrt("id")).cast("int").alias("part"), F.col("id").alias("k"))
    got = {q["rank"]: q["n_keys"] for q in size_quantiles(sketch_keys(sizes, "part", ["k"])).collect()}
    assert got[0.0] == 1 and 28 <= got[0.5] <= 34 and got[1.0] == 61


def _scanned(df) -> int:
    """Rows that the scans of an executed query read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()  # a scan and a filter: nothing adaptive
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_few_keys_read_few_pages(spark, tmp_path):
    name = "keys_zone_test"
    schema = "k long"
    df = spark.range(400_000).select(F.col("id").alias("k"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        table = KeyTable.open(spark, name, f"{tmp_path}/index", df.schema, None, ["k"], 2)
        table.append(df)
        batch = spark.createDataFrame([(17,), (399_999,), (500_000,), (17,)], schema)
        got = new_rows(batch, table, None, ["k"])
        assert rows(got) == Counter([(500_000,)])
        near = table.near(table.rows(), table.packed(batch))
        assert _scanned(near) < 150_000 < _scanned(table.rows().where("k >= 0"))
        many = table.packed(spark.range(2000).select(F.col("id").alias("k")))
        assert table.near(table.rows(), many).count() == 400_000  # too many keys to look up: no filter
        assert table.near(table.rows(), table.packed(batch.limit(0))).count() == 400_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_copies_of_recent_rows_never_reach_a_load(spark, tmp_path):
    schema = "part int, k string, v string"

    def drop(name, data):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/landing/drop={name}")

    def run(base, recent):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/landing")
        q = load_stream(stream, f"{tmp_path}/{base}", "part", ["k"], f"{tmp_path}/{base}-checkpoint", trigger={"availableNow": True}, compact_every=0, recent=recent)
        q.awaitTermination()
        assert q.exception() is None

    drop("1", [(1, "a", "x"), (1, "a", "x"), (None, "n", "x"), (2, None, "x")])
    for base, recent in (("plain", None), ("filtered", "1 hour"), ("brief", "0 seconds")):
        run(base, recent)
    drop("2", [(1, "a", "x"), (1, "b", "x"), (None, "n", "x"), (2, None, "x"), (2, "a", "x")])
    drop("3", [(1, "b", "x"), (3, "c", "x"), (1, "a", "x")])
    for base, recent in (("plain", None), ("filtered", "1 hour"), ("brief", "0 seconds")):
        run(base, recent)
    masters = {b: rows(tables.read_master(spark, f"{tmp_path}/{b}", spark.createDataFrame([], schema).schema).drop("batch_id")) for b in ("plain", "filtered", "brief")}
    assert masters["plain"] == masters["filtered"] == masters["brief"]
    assert masters["plain"] == Counter({(1, "a", "x"): 1, (None, "n", "x"): 1, (2, None, "x"): 1, (1, "b", "x"): 1, (2, "a", "x"): 1, (3, "c", "x"): 1})
    assert glob.glob(f"{tmp_path}/filtered-checkpoint/state/*")


def test_the_filter_lets_only_first_copies_through(spark, tmp_path):
    from increload.streaming.micro_batch import drop_recent_copies

    schema = "part int, k string, v string"
    seen = []

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/landing")
        out = drop_recent_copies(stream, "part", ["k"], "1 hour")
        assert out.columns == ["part", "k", "v"]
        q = out.writeStream.foreachBatch(lambda df, i: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/cp")
        q.trigger(availableNow=True).start().awaitTermination()

    for i, data in enumerate(([(1, "a", "x"), (1, "a", "x"), (None, None, "x")], [(1, "a", "x"), (2, "a", "x"), (None, None, "x")])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/landing/drop={i}")
        run()  # the second run is a restart: the state is read back
    assert Counter(seen) == Counter([(1, "a", "x"), (None, None, "x"), (2, "a", "x")])
