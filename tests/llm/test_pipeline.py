from __future__ import annotations

from collections import Counter

import corpus_pipeline as P
import __spark_entry__ as E
from increload.llm.common import gapless, stage
from increload.llm.packing import pack
from increload.llm.simhash import simhash_components

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(E.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1


def test_stages_take_effect(spark, docs):
    seen = {"raw": docs}
    for name, step in P.STAGES[:-1]:
        out = stage(step(spark, list(seen.values())[-1], SF), name)
        assert out.columns == docs.columns
        seen[name] = out
    counts = {k: v.count() for k, v in seen.items()}
    assert counts["quality"] < counts["raw"] and counts["line_dedup"] == counts["quality"]
    assert counts["near_dedup"] < counts["line_dedup"]
    groups = simhash_components(seen["line_dedup"]).collect()
    assert counts["near_dedup"] == len({r["component_id"] for r in groups})
    assert {r["doc_id"] for r in seen["near_dedup"].collect()} == {r["component_id"] for r in groups}
    assert max(Counter(r["doc_id"] for r in seen["mix"].collect()).values()) <= 3
    last = P.STAGES[-1][1](spark, seen["mix"], SF)
    assert sum(r["length"] for r in last.collect()) == sum(r["doc_tokens"] for r in last.where("start = 0").collect())


def test_run_equals_its_stages_on_the_packed_tokens(spark):
    out = P.run(spark, SF)
    assert out.columns == pack(spark.read.parquet(f"{SF}/documents.parquet"), P.public_tokenizers.path("word_bpe_49k.json")).columns
    assert out.count() > 0


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    for name, step in P.STAGES:
        for df in (odd_docs, no_docs):
            out = step(spark, df, SF)
            out.collect()
            assert name == "packing" or out.columns == df.columns


def test_gapless_numbers(spark):
    df = stage(spark.range(1000).selectExpr("cast(id % 3 as int) as g", "cast(id % 7 as int) as sub", "id"), "t")
    rows = gapless(df, ["g"], "sub", ["id"], "n").collect()
    for g in range(3):
        assert sorted(r["n"] for r in rows if r["g"] == g) == list(range(sum(r["g"] == g for r in rows)))
