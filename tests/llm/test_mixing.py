from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from increload.llm.mixing import mix_decisions, mix_sources


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes, weights=(5, 2, 1), cap=3.0):
    """Shares reshared until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed = {}
    while True:
        free = [s for s in order if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        total = sum(w[s] for s in free)
        now = {s: left * w[s] / total for s in free}
        above = [s for s in free if now[s] > cap * sizes[s]]
        if not above:
            return fixed | now
        fixed |= {s: cap * sizes[s] for s in above}


def check(df):
    given = df.collect()
    rows = mix_decisions(df).collect()
    sizes, largest = Counter(), defaultdict(int)
    for r in given:
        sizes[r["source"]] += words(r["text"])
        largest[r["source"]] = max(largest[r["source"]], words(r["text"]))
    want = targets(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], words(r["text"])) for r in given)
    taken = Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        if r["size"]:
            rate = r["target"] / r["source_size"]
            assert int(rate) <= r["copies"] <= int(rate) + 1
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    return rows


def test_documents(docs):
    rows = check(docs)
    again = mix_decisions(docs.repartition(5)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_capped_sources_and_many_groups(spark):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 17).cast("int")), " ").alias("text"),
        F.when(F.col("id") < 40, "a").when(F.col("id") < 60, "b").when(F.col("id") < 2500, "c").when(F.col("id") < 2990, "d").alias("source"),
    )
    rows = check(df)
    rates = {r["source"]: r["target"] / r["source_size"] for r in rows}
    assert rates["a"] == 3.0 and max(rates.values()) <= 3.0


def test_odd_documents(odd_docs, no_docs):
    check(odd_docs)
    assert mix_decisions(no_docs).collect() == []
    assert mix_sources(no_docs).collect() == []


def test_mixed_documents_repeat_as_decided(docs, odd_docs):
    for df in (docs, odd_docs):
        mixed = mix_sources(df)
        assert mixed.columns == df.columns
        copies = Counter()
        for r in mix_decisions(df).collect():
            copies[r["doc_id"]] += r["copies"]
        assert Counter(r["doc_id"] for r in mixed.collect()) == +copies


def test_every_document_keeps_its_expected_copies(spark):
    """Over many seeds a document of a source at rate r is taken r times on average."""
    df = spark.range(60).select(
        F.col("id").alias("doc_id"),
        F.array_join(F.array_repeat(F.lit("w"), (1 + F.col("id") % 5).cast("int")), " ").alias("text"),
        F.when(F.col("id") < 30, "a").otherwise("b").alias("source"),
    )
    total, rate = Counter(), {}
    for seed in range(12):
        for r in mix_decisions(df, seed=seed).collect():
            total[r["doc_id"]] += r["copies"]
            rate[r["doc_id"]] = r["target"] / r["source_size"]
    means = [total[i] / 12 - rate[i] for i in rate]
    assert abs(sum(means) / len(means)) < 0.08
    assert max(map(abs, means)) < 0.6
