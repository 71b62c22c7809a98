"""Cases the reference leaves untested (null keys, scopes, order, retries)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from increload import (
    anti_join_keys,
    append_delta,
    dedup_batch,
    incremental_load,
    index_coverage,
    prune_to_batch_partitions,
    read_master,
    run_load_job,
    sql_dedup,
)
from increload.sources import tables

S = "part int, k string, v string"


def test_null_key_is_filtered_null_safely(spark):
    master = spark.createDataFrame([(1, None, "a")], S)
    batch = spark.createDataFrame([(1, None, "b"), (1, "x", "c")], S)
    out = incremental_load(batch, master, None, "part", ["k"]).delta
    assert rows(out, "k") == rows(spark.createDataFrame([("x",)], "k string"))
    # plain SQL equality would have leaked the null key
    leaked = anti_join_keys(batch, master, "part", ["k"], nulls="sql")
    assert leaked.count() == 2


def test_null_partition_is_its_own_partition(spark):
    master = spark.createDataFrame([(0, "x", "a")], S)
    batch = spark.createDataFrame([(None, "x", "a")], S)
    out = incremental_load(batch, master, None, "part", ["k"]).delta
    assert out.count() == 1
    # and a null partition already loaded does filter
    master2 = spark.createDataFrame([(None, "x", "a")], S)
    assert incremental_load(batch, master2, None, "part", ["k"]).delta.count() == 0


def test_scope_changes_the_answer(spark):
    batch = spark.createDataFrame([(1, "x", "a"), (2, "x", "a")], S)
    assert dedup_batch(batch, "part", ["k"]).count() == 2
    assert dedup_batch(batch, "part", ["k"], scope="global").count() == 1
    master = spark.createDataFrame([(3, "x", "z")], S)
    assert incremental_load(batch, master, None, "part", ["k"]).delta.count() == 2
    assert incremental_load(batch, master, None, "part", ["k"], scope="global").delta.count() == 0


@pytest.mark.parametrize("n_parts", [1, 3, 200])
def test_order_by_keeps_smallest_any_partitioning(spark, n_parts):
    data = [(1, "k1", v) for v in ["m", "c", "x", "a", "q"]] + [(1, "k2", "b"), (2, "k1", "z")]
    batch = spark.createDataFrame(data, S).repartition(n_parts)
    out = dedup_batch(batch, "part", ["k"], order_by=["v"])
    assert rows(out) == rows(spark.createDataFrame([(1, "k1", "a"), (1, "k2", "b"), (2, "k1", "z")], S))
    # the default also keeps the smallest whole row: repeatable
    assert rows(dedup_batch(batch, "part", ["k"])) == rows(out)


def test_composite_key_is_a_tuple(spark):
    master = spark.createDataFrame([(1, "a", "b")], S)
    batch = spark.createDataFrame([(1, "a", "b"), (1, "a", "c"), (1, "b", "b"), (1, None, "b")], S)
    out = incremental_load(batch, master, None, "part", ["k", "v"]).delta
    assert rows(out, "k", "v") == rows(spark.createDataFrame([("a", "c"), ("b", "b"), (None, "b")], "k string, v string"))


def test_result_independent_of_shuffle_partitions(spark):
    data = [(d, str(i % 13), str(i)) for d in range(5) for i in range(60)]
    batch = spark.createDataFrame(data, S)
    master = spark.createDataFrame([(d, str(i), "m") for d in range(3) for i in range(5)], S)
    results = []
    for n in ["1", "7", "200"]:
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(rows(incremental_load(batch, master, None, "part", ["k"]).delta))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]
    assert sum(results[0].values()) == 5 * 13 - 3 * 5


def test_index_missing_for_a_batch_is_rebuilt(spark, tmp_base):
    b1 = spark.createDataFrame([(1, "a", "x"), (1, "b", "x")], S)
    b2 = spark.createDataFrame([(1, "c", "x"), (2, "a", "x")], S)
    run_load_job(spark, b1, tmp_base, 1, "part", ["k"])
    # batch 2 lands and commits its data, then the job dies before the index
    append_delta(b2, tmp_base, 2, "part", "a1")
    tables.write_commit(spark, tmp_base, "data", 2, 2, "a1")
    cov = {r["batch_id"]: r["has_index"] for r in index_coverage(spark, tmp_base).collect()}
    assert cov == {1: True, 2: False}
    # batch 3 repeats everything: nothing new, the landed rows of batch 2 filter it
    b3 = b1.unionByName(b2).unionByName(spark.createDataFrame([(2, "z", "x")], S))
    rep = run_load_job(spark, b3, tmp_base, 3, "part", ["k"])
    assert rep.rebuilt_batches == (2,)
    assert rep.n_rows == 1
    master = read_master(spark, tmp_base, b1.schema)
    assert master.count() == 5
    assert master.select("part", "k").distinct().count() == 5


def test_crash_before_data_commit_is_invisible_and_retry_replaces(spark, tmp_base):
    b1 = spark.createDataFrame([(1, "a", "x")], S)
    run_load_job(spark, b1, tmp_base, 1, "part", ["k"])
    b2 = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "b", "y")], S)
    # a failed attempt wrote rows (even wrong ones) but never committed
    append_delta(spark.createDataFrame([(1, "junk", "x")] * 3, S), tmp_base, 2, "part", tables.new_attempt())
    assert read_master(spark, tmp_base, b1.schema).count() == 1
    rep = run_load_job(spark, b2, tmp_base, 2, "part", ["k"])
    assert rep.n_rows == 1
    # retry of an already committed batch writes nothing
    again = run_load_job(spark, b2, tmp_base, 2, "part", ["k"])
    assert again.n_rows == 1 and again.repeated and not rep.repeated
    master = read_master(spark, tmp_base, b1.schema)
    assert rows(master, "k") == rows(spark.createDataFrame([("a",), ("b",)], "k string"))


def test_prune_keeps_null_partition_and_falls_back_to_semi_join(spark):
    keys = spark.createDataFrame([(1, "a", "-"), (2, "b", "-"), (None, "c", "-"), (3, "d", "-")], S)
    batch = spark.createDataFrame([(1, "x", "-"), (None, "y", "-")], S)
    assert rows(prune_to_batch_partitions(keys, batch, "part"), "k") == rows(
        spark.createDataFrame([("a",), ("c",)], "k string")
    )
    semi = prune_to_batch_partitions(keys, batch, "part", max_values=1)
    assert rows(semi, "k") == rows(spark.createDataFrame([("a",), ("c",)], "k string"))


def test_sql_baseline_keeps_null_keys_and_matches_on_key_only(spark):
    master = spark.createDataFrame([(1, None, "a"), (1, "x", "a")], S)
    batch = spark.createDataFrame([(1, None, "b"), (2, "x", "c"), (2, "y", "c"), (2, "y", "d")], S)
    counts = sql_dedup(batch, master, "part", ["k"], ["v"], output="counts")
    got = {(r["k"], r["part"]): r["n_v"] for r in counts.collect()}
    # null key kept although master has one; x dropped although its partition differs
    assert got == {(None, 1): 1, ("y", 2): 2}
    one = sql_dedup(batch, master, "part", ["k"], output="one")
    assert {(r["k"], r["v"]) for r in one.collect()} == {(None, "b"), ("y", "c")}


def test_map_columns_still_dedup(spark):
    df = spark.createDataFrame([(1, "a", {"x": 1}), (1, "a", {"x": 1}), (1, "b", {"y": 2})], "part int, k string, m map<string,int>")
    assert dedup_batch(df, "part", ["k"]).count() == 2
    # a map column rides along with the row the orderable columns choose
    s = "part int, k string, v string, m map<string,int>"
    df2 = spark.createDataFrame([(1, "a", "z", {"z": 1}), (1, "a", "b", {"b": 2}), (1, "a", "m", {"m": 3})], s)
    for order in (["v"], None):
        out = dedup_batch(df2, "part", ["k"], order_by=order).collect()
        assert [(r["v"], r["m"]) for r in out] == [("b", {"b": 2})]


@pytest.mark.parametrize("output", ["counts", "one"])
def test_sql_text_baseline_agrees(spark, output):
    from increload import sql_dedup_text

    master = spark.createDataFrame([(1, None, "a"), (1, "x", "a"), (1, "x", "b"), (2, "q", "a")], S)
    batch = spark.createDataFrame([(1, None, "b"), (2, "x", "c"), (2, "y", "c"), (2, "y", "d"), (3, "q", "e")], S)
    a = sql_dedup(batch, master, "part", ["k"], output=output)
    b = sql_dedup_text(batch, master, "part", ["k"], output=output)
    assert a.columns == b.columns
    assert rows(a) == rows(b)
    # key-only matching: q loaded in part 2 (a part the batch touches) filters q in part 3
    assert ("q",) not in {(r["k"],) for r in b.collect()}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("increload_")]


def test_compaction_merges_and_later_loads_read_only_it(spark, tmp_base):
    from increload import compact_key_index, read_key_index

    b1 = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, "a", "x")], S)
    b2 = spark.createDataFrame([(1, "c", "x"), (2, "b", "x")], S)
    run_load_job(spark, b1, tmp_base, 1, "part", ["k"])
    # batch 2's index is lost: compaction must take its keys from master
    append_delta(b2, tmp_base, 2, "part", "a1")
    tables.write_commit(spark, tmp_base, "data", 2, 2, "a1")
    ks = tables.key_schema_of(b1.schema, "part", ["k"])
    assert compact_key_index(spark, tmp_base, ks, "part") == 1
    assert compact_key_index(spark, tmp_base, ks, "part") == 1  # nothing new: no-op
    idx = read_key_index(spark, tmp_base, ks)
    assert rows(idx, "part", "k", "batch_id") == rows(
        spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 1), (1, "c", 2), (2, "b", 2)], "part int, k string, batch_id long")
    )
    b3 = b1.unionByName(b2).unionByName(spark.createDataFrame([(3, "a", "x")], S))
    assert run_load_job(spark, b3, tmp_base, 3, "part", ["k"]).n_rows == 1
    files = tables.existing_keys(spark, tmp_base, ks).inputFiles()
    assert files and all("/index_compact/segment=1/" in f or "/index/batch_id=3/" in f for f in files)
    # a compacted batch is still committed: loading it again appends nothing
    assert run_load_job(spark, b2, tmp_base, 2, "part", ["k"]).repeated
    # a second compaction folds in batch 3
    assert compact_key_index(spark, tmp_base, ks, "part") == 2
    assert read_key_index(spark, tmp_base, ks).count() == 6
    assert read_master(spark, tmp_base, b1.schema).count() == 6


def test_compaction_rolls_the_commit_log(spark, tmp_base):
    from increload import compact_key_index, compact_master

    mk = lambda rows: spark.createDataFrame(rows, S)
    schema = mk([(1, "a", "x")]).schema
    ks = tables.key_schema_of(schema, "part", ["k"])
    run_load_job(spark, mk([(1, "a", "x")]), tmp_base, 1, "part", ["k"])
    run_load_job(spark, mk([(1, "b", "x")]), tmp_base, 2, "part", ["k"])
    run_load_job(spark, mk([(1, "c", "x")]), tmp_base, 3, "part", ["k"])
    # partial compaction: batch 2 is carried over as it is
    assert compact_key_index(spark, tmp_base, ks, "part", batch_ids=[1, 3]) == 1
    state = tables.read_state(spark, tmp_base)
    assert {b: c.index_segment for b, c in state.batches.items()} == {1: 1, 2: None, 3: 1}
    run_load_job(spark, mk([(1, "a", "x"), (1, "d", "x")]), tmp_base, 4, "part", ["k"])
    files = tables.read_commits(spark, tmp_base).inputFiles()
    assert files and all("/commits_compact/gen=1/" in f or "/commits/gen=1/" in f for f in files)
    assert {r["batch_id"]: r["has_index"] for r in index_coverage(spark, tmp_base).collect()} == {
        1: True, 2: True, 3: True, 4: True,
    }
    # a compaction that dies before its marker is ignored, and its leftovers are replaced
    spark.createDataFrame([], tables.COMMIT_SCHEMA).write.parquet(f"{tmp_base}/commits_compact/gen=2")
    mk([(9, "zz", "x")]).withColumn("batch_id", F.lit(1)).write.parquet(f"{tmp_base}/index_compact/segment=2")
    assert tables.generation(spark, tmp_base) == 1
    assert read_master(spark, tmp_base, schema).count() == 4
    assert compact_key_index(spark, tmp_base, ks, "part") == 2
    assert compact_master(spark, tmp_base, schema, "part") == 3
    state = tables.read_state(spark, tmp_base)
    assert (state.batches, state.data_segments, state.index_segments) == ({}, (3,), (1, 2))
    assert read_master(spark, tmp_base, schema).count() == 4
    assert run_load_job(spark, mk([(1, "d", "y"), (1, "e", "x")]), tmp_base, 5, "part", ["k"]).n_rows == 1
    master = read_master(spark, tmp_base, schema)
    assert sorted((r["batch_id"], r["k"]) for r in master.collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]
    assert compact_master(spark, tmp_base, schema, "part", full=True) == 4
    assert compact_key_index(spark, tmp_base, ks, "part", full=True) == 5
    state = tables.read_state(spark, tmp_base)
    assert (state.batches, state.data_segments, state.index_segments) == ({}, (4,), (5,))
    assert rows(read_master(spark, tmp_base, schema)) == rows(master)


def test_master_compacted_before_its_index(spark, tmp_base):
    """A batch that lost its index takes its keys from the master segment."""
    from increload import compact_master, read_key_index

    b1 = spark.createDataFrame([(1, "a", "x"), (1, "b", "x")], S)
    append_delta(b1, tmp_base, 1, "part", "a1")
    tables.write_commit(spark, tmp_base, "data", 1, 2, "a1")
    run_load_job(spark, spark.createDataFrame([(1, "c", "x")], S), tmp_base, 2, "part", ["k"])
    compact_master(spark, tmp_base, b1.schema, "part")
    ks = tables.key_schema_of(b1.schema, "part", ["k"])
    rep = run_load_job(spark, b1.unionByName(spark.createDataFrame([(1, "c", "y"), (1, "d", "y")], S)), tmp_base, 3, "part", ["k"])
    assert (rep.n_rows, rep.rebuilt_batches) == (1, (1,))
    # a retry of batch 1 finishes its index from the segment
    run_load_job(spark, b1, tmp_base, 1, "part", ["k"])
    assert rows(read_key_index(spark, tmp_base, ks), "k") == rows(spark.createDataFrame([(k,) for k in "abcd"], "k string"))


def committed_rows(spark, base, schema):
    return sorted((r["part"], r["k"]) for r in read_master(spark, base, schema).collect())


@pytest.mark.parametrize("stage", ["data", "index"])
def test_failing_retry_loses_no_committed_row(spark, tmp_base, monkeypatch, stage):
    """A retry of a committed batch whose write fails, before and after its index commit."""
    b1 = spark.createDataFrame([(1, str(i), "x") for i in range(5)], S)
    b2 = spark.createDataFrame([(1, str(i), "y") for i in range(3, 10)], S)
    run_load_job(spark, b1, tmp_base, 1, "part", ["k"])
    if stage == "data":  # the job dies between its commits
        with monkeypatch.context() as m:
            m.setattr(tables, "write_key_index", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
            with pytest.raises(RuntimeError, match="died"):
                run_load_job(spark, b2, tmp_base, 2, "part", ["k"])
    else:
        run_load_job(spark, b2, tmp_base, 2, "part", ["k"])
    want = [(1, str(i)) for i in range(10)]
    assert committed_rows(spark, tmp_base, b1.schema) == want
    with monkeypatch.context() as m:  # any write of the retry fails
        boom = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("disk"))
        m.setattr(tables, "append_delta", boom)
        m.setattr(tables, "write_key_index", boom)
        if stage == "data":
            with pytest.raises(RuntimeError, match="disk"):
                run_load_job(spark, b2, tmp_base, 2, "part", ["k"])
        else:
            assert run_load_job(spark, b2, tmp_base, 2, "part", ["k"]).repeated
    assert committed_rows(spark, tmp_base, b1.schema) == want
    run_load_job(spark, b2, tmp_base, 2, "part", ["k"])
    assert run_load_job(spark, b1.unionByName(b2), tmp_base, 3, "part", ["k"]).n_rows == 0
    assert committed_rows(spark, tmp_base, b1.schema) == want
    assert all(r["has_index"] for r in index_coverage(spark, tmp_base).collect())


def test_write_failing_in_a_task_leaves_no_trace(spark, tmp_base):
    b1 = spark.createDataFrame([(1, "a", "x")], S)
    run_load_job(spark, b1, tmp_base, 1, "part", ["k"])
    bad = spark.createDataFrame([(1, "b", "x"), (1, "c", "x")], S).withColumn(
        "v", F.when(F.col("k") == "c", F.raise_error(F.lit("broken row"))).otherwise(F.col("v"))
    )
    for land in (True, False):
        with pytest.raises(Exception, match="broken row"):
            run_load_job(spark, bad, tmp_base, 2, "part", ["k"], land=land)
        assert committed_rows(spark, tmp_base, b1.schema) == [(1, "a")]
    good = spark.createDataFrame([(1, "b", "x"), (1, "c", "x")], S)
    assert run_load_job(spark, good, tmp_base, 2, "part", ["k"]).n_rows == 2


def test_an_id_is_not_reused_for_other_input(spark, tmp_base):
    b1 = spark.createDataFrame([(1, "a", "x")], S)
    run_load_job(spark, b1, tmp_base, 1, "part", ["k"])
    with pytest.raises(ValueError, match="other input"):
        run_load_job(spark, spark.createDataFrame([(1, "b", "x")], S), tmp_base, 1, "part", ["k"])
    assert committed_rows(spark, tmp_base, b1.schema) == [(1, "a")]
    with pytest.raises(ValueError, match="streams"):
        run_load_job(spark, b1, tmp_base, 1 << 52, "part", ["k"])


def test_changing_source_is_read_once(spark, tmp_base):
    """A batch that differs at each evaluation: what is loaded is one of its versions, whole."""
    b1 = spark.createDataFrame([(p, "a", "x") for p in range(40)], S)
    run_load_job(spark, b1, tmp_base, 1, "part", ["k"])
    shifty = spark.range(200).select(
        (F.rand() * 40).cast("int").alias("part"), F.lit("a").alias("k"), F.lit("y").alias("v")
    )
    assert run_load_job(spark, shifty, tmp_base, 2, "part", ["k"]).n_rows == 0


def test_estimate_guards_the_loads(spark, tmp_base):
    b1 = spark.createDataFrame([(1, "a", "x")], S)
    none, some = (spark.createDataFrame([(n,)], "estimate long") for n in (0, 3))
    with pytest.raises(ValueError, match="no input file"):
        incremental_load(b1, None, None, "part", ["k"], estimate=none)
    with pytest.raises(ValueError, match="no input file"):
        run_load_job(spark, b1, tmp_base, 1, "part", ["k"], estimate=none)
    assert incremental_load(b1, None, None, "part", ["k"], estimate=some).delta.count() == 1
    assert run_load_job(spark, b1, tmp_base, 1, "part", ["k"], estimate=some).n_rows == 1


def test_collated_keys_match_as_the_collation_says(spark):
    s = "part int, k string collate UTF8_LCASE, v string"
    batch = spark.createDataFrame([(1, "a", "x"), (1, "A", "y"), (1, "b", "z")], s)
    assert dedup_batch(batch, "part", ["k"]).count() == batch.dropDuplicates(["part", "k"]).count() == 2
    master = spark.createDataFrame([(1, "B", "m")], s)
    out = incremental_load(batch, master, None, "part", ["k"]).delta
    assert [r["v"] for r in out.collect()] == ["x"]


def _parts():
    import datetime as dt
    from decimal import Decimal

    # both instants are 01:30 local time in New York, an hour apart
    fold = [dt.datetime(2024, 11, 3, h, 30, tzinfo=dt.timezone.utc) for h in (5, 6)]
    return {
        "timestamp": fold + [None],
        "timestamp_ntz": [dt.datetime(2024, 11, 3, 1, 30), None, dt.datetime(1900, 1, 1)],
        "date": [dt.date(2024, 1, 1), dt.date(1, 1, 1), None],
        "decimal(30,10)": [Decimal("1.0000000001"), Decimal("-99999999999999999999.5"), None],
        "binary": [b"", b"\x00\xff", None],
        "string": ["", "a'b\\", None],
        "double": [0.1, float("nan"), -0.0, None],
        "boolean": [True, False, None],
    }


@pytest.mark.parametrize("max_values", [1000, 0])
@pytest.mark.parametrize("dtype", list(_parts()))
def test_pruning_never_changes_the_answer(spark, dtype, max_values, monkeypatch):
    import time

    values = _parts()[dtype]
    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        s = f"part {dtype}, k int, v string"
        master = spark.createDataFrame([(p, k, "m") for p in values[:2] for k in range(3)], s)
        batch = spark.createDataFrame([(p, k, "b") for p in values for k in range(2, 5)], s)
        plain = incremental_load(batch, master, None, "part", ["k"], prune=False).delta
        pruned = incremental_load(batch, master, None, "part", ["k"], max_prune_values=max_values).delta
        assert plain.count() == pruned.count() == 3 * len(values) - 2
        assert plain.exceptAll(pruned).isEmpty() and pruned.exceptAll(plain).isEmpty()
        again = incremental_load(batch, batch, None, "part", ["k"], max_prune_values=max_values).delta
        assert again.isEmpty()
    finally:
        monkeypatch.undo()
        time.tzset()


def test_sql_text_with_maps_and_quotes(spark):
    from increload import sql_dedup_text

    s = "part int, k string, `it's` string, m map<string,int>"
    master = spark.createDataFrame([(1, "a", "x", {})], s)
    batch = spark.createDataFrame([(1, "b", "q", {"z": 1}), (1, "b", "p", {"y": 2}), (1, "a", "r", {})], s)
    a = sql_dedup(batch, master, "part", ["k"], output="one").collect()
    b = sql_dedup_text(batch, master, "part", ["k"], output="one").collect()
    assert a == b and [(r["k"], r["it's"], r["m"]) for r in b] == [("b", "p", {"y": 2})]


def test_stored_load_without_partition_column(spark, tmp_base):
    s = "k long, v string"
    run_load_job(spark, spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], s), tmp_base, 1, None, ["k"])
    rep = run_load_job(spark, spark.createDataFrame([(2, "c"), (3, "c"), (None, "n")], s), tmp_base, 2, None, ["k"])
    assert rep.n_rows == 2
    master = read_master(spark, tmp_base, spark.createDataFrame([], s).schema)
    assert rows(master, "k", "v") == rows(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "n")], s))


def test_reserved_column_names_are_rejected(spark, tmp_base):
    df = spark.createDataFrame([(1, "a", 7)], "part int, k string, batch_id long")
    with pytest.raises(ValueError):
        run_load_job(spark, df, tmp_base, 1, "part", ["k"])


def test_awkward_partition_values_round_trip(spark, tmp_base):
    import datetime as dt

    s = "p string, d date, k long, v string"
    odd = ["a/b", "x=y", "50%", "sp ace", None]
    b1 = spark.createDataFrame([(p, dt.date(2024, 1, 1), i, "v") for p in odd for i in range(3)], s)
    run_load_job(spark, b1, tmp_base, 1, "p", ["k"])
    b2 = spark.createDataFrame([(p, dt.date(2024, 1, 2), i, "w") for p in odd for i in range(2, 5)], s)
    rep = run_load_job(spark, b2, tmp_base, 2, "p", ["k"])
    assert rep.n_rows == len(odd) * 2
    master = read_master(spark, tmp_base, b1.schema)
    assert rows(master, "p", "k") == rows(b1.unionByName(b2).select("p", "k").distinct())
    # "" and null would share the default partition directory
    with pytest.raises(ValueError, match="empty string"):
        run_load_job(spark, spark.createDataFrame([("", dt.date(2024, 1, 1), 1, "v")], s), tmp_base, 3, "p", ["k"])
    # a date partition column works the same way
    base2 = tmp_base + "/by_date"
    run_load_job(spark, b1, base2, 1, "d", ["p", "k"])
    assert run_load_job(spark, b1.unionByName(b2), base2, 2, "d", ["p", "k"]).n_rows == b2.count()
    assert read_master(spark, base2, b1.schema).count() == b1.count() + b2.count()


def test_part_repeated_in_keys(spark):
    batch = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "a", "z")], S)
    assert rows(dedup_batch(batch, "part", ["part", "k"])) == rows(dedup_batch(batch, "part", ["k"]))


def test_anti_join_keys_broadcast_option_same_rows(spark):
    s = "part int, k long, v string"
    batch = spark.createDataFrame([(1, None, "a"), (1, 2, "b"), (1, 2, "c"), (2, 3, "d"), (1, 4, "e")], s)
    known = spark.createDataFrame([(1, None, "-"), (1, 2, "-"), (2, 4, "-")], s)
    plain = anti_join_keys(batch, known, "part", ["k"])
    small = anti_join_keys(batch, known, "part", ["k"], broadcast_budget=1 << 20)
    assert "LeftSemi" in small._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" not in plain._jdf.queryExecution().executedPlan().toString()
    assert rows(small) == rows(plain) == rows(spark.createDataFrame([(2, 3, "d"), (1, 4, "e")], s))
