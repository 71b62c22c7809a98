"""End-to-end loads on the photo-events and members fixtures."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from conftest import rows
from increload import (
    build_key_index,
    dedup_batch,
    incremental_load,
    index_profile,
    read_csv_dir,
    read_key_index,
    read_master,
    run_load_job,
    trim_column_names,
    with_partition_column,
)
from increload.sources import tables

SCHEMA = "date int, photo_id string, photo_loc string, event string"


def photo(date, ids):
    return [(date, str(i), f"loc{i}", "view") for i in ids]


def existing_df(spark):
    return spark.createDataFrame(photo(20170101, range(11, 18)) + photo(20170102, range(21, 28)), SCHEMA)


def new_df(spark):
    data = photo(20170102, [24, 25, 26, 27, 25, 26, 27, 28]) + photo(20170103, [31, 32, 33, 34, 35, 36, 37, 33, 34, 35])
    return spark.createDataFrame(data, SCHEMA)


def index_sizes(index):
    return {r["date"]: r["n_keys"] for r in index_profile(index, "date", ["photo_id"]).collect()}


def test_first_load(spark):
    res = incremental_load(new_df(spark), None, None, "date", ["photo_id"])
    assert res.delta.count() == 12
    assert rows(res.delta) == rows(new_df(spark).distinct())
    assert index_sizes(res.index) == {20170102: 5, 20170103: 7}


def test_index_lost_and_given_agree(spark):
    existing = existing_df(spark)
    lost = incremental_load(new_df(spark), existing, None, "date", ["photo_id"])
    given = incremental_load(new_df(spark), existing, build_key_index(existing, "date", ["photo_id"]), "date", ["photo_id"])
    expected = rows(new_df(spark).subtract(existing))
    assert rows(lost.delta) == expected
    assert rows(given.delta) == expected
    assert sorted(r[1] for r in expected) == sorted(["28", "31", "32", "33", "34", "35", "36", "37"])
    assert index_sizes(lost.index) == {20170101: 7, 20170102: 8, 20170103: 7}
    assert index_sizes(given.index) == {20170101: 7, 20170102: 8, 20170103: 7}
    # The merged index has no duplicate entries.
    assert lost.index.count() == lost.index.distinct().count() == 22


def test_same_batch_again_is_empty(spark):
    existing = existing_df(spark)
    first = incremental_load(new_df(spark), existing, None, "date", ["photo_id"])
    after = existing.unionByName(first.delta)
    again = incremental_load(new_df(spark), after, first.index, "date", ["photo_id"])
    assert again.delta.count() == 0
    assert index_sizes(again.index) == {20170101: 7, 20170102: 8, 20170103: 7}


def test_stored_loads(spark, tmp_base):
    r1 = run_load_job(spark, existing_df(spark), tmp_base, 1, "date", ["photo_id"])
    assert (r1.n_rows, r1.first_load) == (14, True)
    r2 = run_load_job(spark, new_df(spark), tmp_base, 2, "date", ["photo_id"])
    assert (r2.n_rows, r2.first_load) == (8, False)
    r3 = run_load_job(spark, new_df(spark), tmp_base, 3, "date", ["photo_id"])
    assert r3.n_rows == 0
    schema = existing_df(spark).schema
    master = read_master(spark, tmp_base, schema)
    assert master.count() == 22
    assert rows(master.drop("batch_id")) == rows(existing_df(spark).unionByName(new_df(spark)).distinct())
    ks = tables.key_schema_of(schema, "date", ["photo_id"])
    index = read_key_index(spark, tmp_base, ks)
    assert index_sizes(index.drop("batch_id")) == {20170101: 7, 20170102: 8, 20170103: 7}


# Header cells padded with blanks on either side, as spreadsheets write them.
SUBSCRIBER_HEADER = "sub_no ,  nick,  mail ,city, tier ,  year_of_birth "


def subscriber(no, year, nick="n"):
    return f"{no},{nick}{no},{nick}{no}@example.org,Oslo,basic,{year}"


def test_padded_header_csv_demo(spark, tmp_path):
    old_dir, new_dir = tmp_path / "loaded", tmp_path / "increment"
    old_dir.mkdir()
    new_dir.mkdir()
    old = [subscriber(n, y) for n, y in ((10, 1970), (11, 1970), (20, 1982), (21, 1982), (40, 1995), (41, 1995))]
    new = [subscriber(n, y) for n, y in ((50, 2001), (51, 2001), (51, 2001), (42, 1995))]
    new += [subscriber(40, 1995, "renamed"), subscriber(41, 1995, "renamed"), subscriber(60, "unknown")]
    (old_dir / "part1.csv").write_text("\n".join([SUBSCRIBER_HEADER, *old]) + "\n")
    (new_dir / "part1.csv").write_text("\n".join([SUBSCRIBER_HEADER, *new]) + "\n")

    def load(p):
        df = trim_column_names(read_csv_dir(spark, str(p)))
        return with_partition_column(df, "born", "year_of_birth")

    existing, batch = load(old_dir), load(new_dir)
    assert existing.columns == ["sub_no", "nick", "mail", "city", "tier", "year_of_birth", "born"]
    assert all(t == "string" for _, t in existing.dtypes[:-1])
    res = incremental_load(batch, existing, None, "born", ["sub_no"])
    # bad text becomes a null partition; known keys stay as they were loaded
    assert sorted((r["sub_no"], r["born"] or 0) for r in res.delta.collect()) == [("42", 1995), ("50", 2001), ("51", 2001), ("60", 0)]
    assert res.delta.where(F.col("nick").startswith("renamed")).count() == 0
    assert res.delta.schema == batch.schema


def test_dedup_is_multiset_distinct(spark):
    df = new_df(spark)
    out = dedup_batch(df, "date", ["photo_id"])
    assert rows(out) == Counter(set(tuple(r) for r in df.collect()))
    assert out.count() == 12
