from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from increload.llm.simplex_clusters import Simplex, bounds, cluster_vectors, components_sha256, nearest


def brute(rows, k, rounds, dims):
    """Every vector against every centroid, in plain Python; rows are (id, vector)."""
    kept = [(i, tuple(math.floor(64 * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        out = []
        for i, v in kept:
            d, j = min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
            out.append((i, v, j, d))
        return out

    for _ in range(rounds):
        placed = assign()
        for j in range(len(centroids)):
            own = [v for _, v, c, _ in placed if c == j]
            if own:
                centroids[j] = tuple(sum(x) // len(own) for x in zip(*own))
    return sorted((str(i), j, d) for i, _, j, d in assign()), centroids


def found(result):
    return sorted((str(r["id"]), r["cluster"], r["distance"]) for r in result.assigned.collect())


def check(spark, rows, k, rounds, dims, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = cluster_vectors(df, k=k, rounds=rounds, dims=dims, **more)
    want, centroids = brute(rows, k, rounds, dims)
    assert found(got) == want
    assert [tuple(r["components"]) for r in got.centroids.orderBy("cluster").collect()] == centroids
    assert got.inertia == sum(d for _, _, d in want)
    per = {r["cluster"]: (r["members"], r["cluster_inertia"]) for r in got.centroids.collect()}
    for j in range(len(centroids)):
        assert per[j] == (sum(c == j for _, c, _ in want), sum(d for _, c, d in want if c == j))


@pytest.mark.parametrize("dims, spread, pivots", [(3, 0.2, 4), (8, 3.0, 6), (8, 3.0, 1)])
def test_equals_brute_force(spark, dims, spread, pivots):
    rng = random.Random(dims)
    centres = [[rng.gauss(0, 2) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [rng.gauss(c, spread) for c in centres[i % 5]]) for i in range(400)]
    check(spark, rows, k=7, rounds=3, dims=dims, pivots=pivots)


def test_ties_repeated_rows_and_few_vectors(spark):
    same = [0.5, -0.25]
    rows = [(i, same) for i in range(12)] + [(3, [0.0, 0.0]), (3, [0.0, 0.0]), (20, [1.0, 1.0])]
    check(spark, rows, k=16, rounds=2, dims=2)
    # centroids on a line: vectors half way go to the smaller number
    check(spark, [(i, [float(i % 5), 0.0]) for i in range(60)], k=4, rounds=3, dims=2)


def test_unusable_vectors_and_clashing_columns(spark):
    good = [(1, [0.1, 0.2]), (2, [0.3, -0.2]), (None, [0.0, 0.5]), (None, [0.25, 0.5]), (4, [-1.0, 0.0])]
    bad = [(5, None), (6, []), (7, [1.0]), (8, [1.0, None]), (9, [float("nan"), 1.0]), (10, [1.0, float("-inf")])]
    schema = "vec_id long, embedding array<double>, id string, cluster int, v int, apex int"
    df = spark.createDataFrame([(*r, "x", 9, 1, 2) for r in good + bad], schema)
    got = cluster_vectors(df, k=4, rounds=1, dims=2)
    assert found(got) == brute(good, 4, 1, 2)[0]
    empty = cluster_vectors(df.limit(0), dims=2)
    assert empty.assigned.collect() == [] and empty.centroids.collect() == [] and empty.inertia == 0


def test_large_components(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-2e6, 2e6) for _ in range(4)]) for i in range(100)]
    check(spark, rows, k=5, rounds=2, dims=4)
    df = spark.createDataFrame([(1, [1e300, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        cluster_vectors(df, dims=2)


def test_bounds_hold_and_leave_out_centroids():
    rng = np.random.default_rng(5)
    centres = rng.integers(-60, 60, (12, 16))
    values = np.concatenate([c + rng.integers(-3, 4, (200, 16)) for c in centres])
    simplex = Simplex(centres, 8)
    a, c = simplex.apex(simplex.squared(values)), simplex.apex(simplex.squared(centres))
    low, high = bounds(a, c)
    true = ((values[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (low <= true * (1 + 1e-9) + 1e-6).all() and (high >= true * (1 - 1e-9) - 1e-6).all()
    cluster, distance, compared = nearest(values, a, centres, c, measure=True)
    assert (cluster == true.argmin(axis=1)).all() and (distance == true.min(axis=1)).all()
    assert compared.mean() < 3  # of twelve


def test_pivots_on_one_line_span_one_dimension():
    simplex = Simplex([[i, 2 * i, 0] for i in (0, 3, 5, 9)], 4)
    assert len(simplex.pivots) == 2
    assert len(Simplex([[1, 1]] * 5, 4).pivots) == 1


def test_digest_of_components():
    assert components_sha256([1, -2]) == hashlib.sha256(b"1,-2").hexdigest()
