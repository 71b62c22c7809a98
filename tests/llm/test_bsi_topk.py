from __future__ import annotations

import math
import random

import numpy as np
import pytest

from increload.llm.bsi_topk import bit_sliced_top_k, build_slices, search_block


def brute(rows, is_query, k):
    vecs = {i: [math.floor(64 * float(x)) for x in v] for i, v in rows}
    out = {}
    for q in filter(is_query, vecs):
        scores = sorted(((-sum(a * b for a, b in zip(vecs[q], v)), i) for i, v in vecs.items() if i != q))
        out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def found(df):
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("scale", [0.1, 1.0, 40.0])
def test_blocks_and_ties(spark, scale):
    rng = random.Random(int(scale * 10))
    rows = [(i, [round(rng.gauss(0, scale), 2) for _ in range(5)]) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 460)]  # equal vectors: ties by id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = found(bit_sliced_top_k(df, lambda i: i % 20 == 0, k=9, block_rows=100, query_rows=5))
    assert got == brute(rows, lambda i: i % 20 == 0, 9)


def test_fewer_rows_than_k(spark):
    rows = [(20, [0.5, -0.5]), (1, [0.5, -0.5]), (2, [-1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(bit_sliced_top_k(df, lambda i: i % 20 == 0)) == brute(rows, lambda i: i == 20, 20)


def test_unusable_rows_take_no_part(spark):
    good = [(0, [0.1, 0.2]), (1, [0.3, -0.2]), (2, [0.0, 0.0])]
    bad = [(20, None), (40, []), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (None, [1.0, 1.0]), (120, [1.0])]
    repeated = [(1, [0.3, -0.2]), (0, [5.0, 5.0])]  # of rows with one id the smallest counts
    schema = "vec_id long, embedding array<double>, score int"
    df = spark.createDataFrame([(*r, 7) for r in good + bad + repeated], schema)
    assert found(bit_sliced_top_k(df, lambda i: i % 20 == 0)) == brute(good, lambda i: i % 20 == 0, 20)
    assert bit_sliced_top_k(df.limit(0), lambda i: i % 20 == 0).collect() == []
    assert bit_sliced_top_k(spark.createDataFrame(bad[:3], "vec_id long, embedding array<double>"), lambda i: i > 0).collect() == []


def test_scores_beyond_a_long_raise(spark):
    df = spark.createDataFrame([(0, [1e17, 1.0]), (1, [-1e17, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="long"):
        bit_sliced_top_k(df, lambda i: i == 0)


def test_one_block_against_numpy():
    rng = np.random.default_rng(1)
    values = rng.integers(-37, 90, size=(1000, 11))
    slices = build_slices(values, -37, 7)
    ids = np.arange(1000) * 3
    q, v, s = search_block(ids, slices, ids[:5], values[:5], -37, 7, 50)
    for i in range(5):
        scores = values @ values[i]
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:50]
        assert dict(zip(v[q == ids[i]], s[q == ids[i]])) == {ids[j]: scores[j] for j in order}
