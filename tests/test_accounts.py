"""What a stored load reports, and which batch it takes for the same."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from increload import run_load_job
from increload.sources import tables

S = "part int, k string, n int, v string"


def accounts(rows, known):
    """Rows are (part, k, n, v), the key is (part, k, n); known is a set of keys, extended."""
    keys = {r[:3] for r in rows}
    old = keys & known
    out = (len(rows), sum(r[1] is None or r[2] is None for r in rows), len(rows) - len(keys), len(old), len(keys) - len(old))
    known |= keys
    return out


def told(r):
    return (r.n_input, r.n_null_keys, r.n_copies, r.n_known, r.n_rows)


@pytest.mark.parametrize("budget", [64 << 20, 0, 1])
@pytest.mark.parametrize("land", [True, False])
def test_accounts_equal_brute_force(spark, tmp_base, budget, land):
    rng = random.Random(7)
    known: set = set()
    for batch_id, n in enumerate((30, 25, 1, 40)):
        rows = [(rng.choice([1, 2, None]), rng.choice(["a", "b", "c", None]), rng.choice([0, 1, 2, None]), rng.choice(["x", "y"])) for _ in range(n)]
        want = accounts(rows, known)
        df = spark.createDataFrame(rows, S).repartition(3)
        assert told(run_load_job(spark, df, tmp_base, batch_id, "part", ["k", "n"], broadcast_budget=budget, land=land)) == want
        again = accounts(rows, known)  # all of it known: nothing reaches the write
        got = run_load_job(spark, df, tmp_base, 100 + batch_id, "part", ["k", "n"], broadcast_budget=budget, land=land)
        assert told(got) == again and got.n_rows == 0
    keys = tables.existing_keys(spark, tmp_base, tables.key_schema_of(spark.createDataFrame([], S).schema, "part", ["k", "n"]))
    assert {tuple(r) for r in keys.collect()} == known and keys.count() == len(known)


def test_empty_batch_and_retry(spark, tmp_base):
    empty = spark.createDataFrame([], S)
    assert told(run_load_job(spark, empty, tmp_base, 1, "part", ["k"])) == (0, 0, 0, 0, 0)
    df = spark.createDataFrame([(1, "a", 1, "x"), (1, "a", 1, "y")], S)
    assert told(run_load_job(spark, df, tmp_base, 2, "part", ["k"])) == (2, 0, 1, 0, 1)
    again = run_load_job(spark, df, tmp_base, 2, "part", ["k"])
    assert again.repeated and told(again) == (None, None, None, None, 1)
    assert told(run_load_job(spark, empty, tmp_base, 3, "part", ["k"])) == (0, 0, 0, 0, 0)


def test_the_same_keys_with_another_payload_are_another_batch(spark, tmp_base):
    rows = [(1, "a", 1, "x"), (1, "b", 1, "x"), (1, "b", 1, "x")]
    run_load_job(spark, spark.createDataFrame(rows, S), tmp_base, 1, "part", ["k"])
    run_load_job(spark, spark.createDataFrame(rows[::-1], S).repartition(3), tmp_base, 1, "part", ["k"])
    for other in ([(1, "a", 1, "z"), *rows[1:]], [rows[0], (1, "b", 1, "y"), (1, "b", 1, "y")]):
        with pytest.raises(ValueError, match="other input"):
            run_load_job(spark, spark.createDataFrame(other, S), tmp_base, 1, "part", ["k"])


def test_tags_of_earlier_versions_tell_the_keys_only(spark, tmp_base):
    df = spark.createDataFrame([(1, "a", 1, "x")], S)
    run_load_job(spark, df, tmp_base, 1, "part", ["k"])
    state = tables.read_state(spark, tmp_base, 1)
    old = state.asked.tag.rpartition("-")[0]
    assert old.count("-") == 1
    tables.write_commit(spark, tmp_base, "data", 1, 1, state.asked.data, old, state.gen)
    assert run_load_job(spark, df.withColumn("v", F.lit("other")), tmp_base, 1, "part", ["k"]).repeated
    with pytest.raises(ValueError, match="other input"):
        run_load_job(spark, df.withColumn("k", F.lit("b")), tmp_base, 1, "part", ["k"])


def test_maps_count_in_the_checksum(spark, tmp_base):
    df = spark.sql("SELECT 1 AS k, map('a', 1, 'b', 2) AS m")
    run_load_job(spark, df, tmp_base, 1, None, ["k"])
    assert run_load_job(spark, spark.sql("SELECT 1 AS k, map('b', 2, 'a', 1) AS m"), tmp_base, 1, None, ["k"]).repeated
    with pytest.raises(ValueError, match="other input"):
        run_load_job(spark, spark.sql("SELECT 1 AS k, map('b', 2, 'a', 3) AS m"), tmp_base, 1, None, ["k"])
