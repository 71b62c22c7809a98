from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from increload.llm.hilbert import equal_bins, hilbert_index, shard_documents, string_bin, write_shards


@pytest.mark.parametrize(("bits", "dims"), [(1, 2), (3, 2), (4, 2), (2, 3), (3, 3), (2, 4)])
def test_curve_visits_every_cell_by_unit_steps(spark, bits, dims):
    cells = list(product(range(1 << bits), repeat=dims))
    names = [f"q{i}" for i in range(dims)]
    df = spark.createDataFrame(cells, ", ".join(f"{n} int" for n in names))
    rows = df.withColumn("h", hilbert_index(F.array(*names), bits, dims)).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(len(cells)))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(a[n] - b[n]) for n in names) == 1


def check(df, n_shards):
    rows = shard_documents(df, n_shards).collect()
    texts = Counter((r["doc_id"], r["text"] or "") for r in df.collect())
    want = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for (i, t), n in texts.items() for _ in range(n))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    counts = [len(slots.get(s, [])) for s in range(n_shards)]
    assert max(counts) - min(counts) <= 1
    order = [r["curve"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    return rows


@pytest.mark.parametrize("n_shards", [1, 3, 16])
def test_documents(docs, n_shards):
    check(docs, n_shards)


def test_hot_cell_is_divided(spark, monkeypatch):
    from increload.llm import hilbert

    monkeypatch.setattr(hilbert, "RANKED_ROWS", 20)
    df = spark.range(500).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("text"),
        F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(4).cast("long").alias("n_chars"),
    )
    check(df, 16)


def test_odd_documents(odd_docs, no_docs):
    check(odd_docs, 16)
    assert shard_documents(no_docs).collect() == []


def test_equal_bins():
    assert equal_bins({0: 10}, 4) == []
    assert equal_bins({i: 1 for i in range(8)}, 4) == [2, 4, 6]
    assert equal_bins({0: 90, 1: 5, 2: 5}, 4) == [1]


def test_written_shards_hold_every_row(spark, docs, tmp_path):
    write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.drop("shard").count() == docs.count()
    assert back.select("shard").distinct().count() == 16
    spread = back.groupBy("shard").agg(F.count_distinct("lang").alias("n")).agg(F.avg("n")).first()[0]
    assert spread < docs.select("lang").distinct().count()


def test_values_keep_their_own_bins(spark):
    """Beside nulls, an outlier and a long common prefix."""
    values = [None, "a", *[f"https://example.org/source{i:02}" for i in range(20)]]
    df = spark.createDataFrame([(v,) for v in values for _ in range(1 if v in (None, "a") else 50)], "c string")
    rows = df.select("c", string_bin(df, "c", 32).alias("q")).distinct().collect()
    assert [r["q"] for r in sorted(rows, key=lambda r: r["c"] or "")] == list(range(22))


def test_many_values_fill_bins_equally(spark):
    df = spark.range(6400).select(F.when(F.col("id") > 0, F.format_string("https://example.org/%05d", "id")).alias("c"))
    counts = Counter(r["q"] for r in df.select(string_bin(df, "c", 32).alias("q")).collect())
    assert set(counts) == set(range(32)) and counts[0] == 1
    assert all(200 <= n <= 210 for q, n in counts.items() if q)
