"""Centroid clustering with n-simplex bounds before exact integer distances.

Vectors become whole numbers, ``floor(scale * x)``.  A few of the starting
centroids serve as pivots: their mutual distances span a simplex, and the
distances of any vector to them give the apex of a larger simplex over that
base.  For two apexes ``a`` and ``b`` the Euclidean distance of the two is a
lower bound of the distance of the vectors, and the distance with the last
coordinate (the altitude) mirrored is an upper bound.  Each vector's apex is
computed once and kept beside it; each round computes the apexes of the few
centroids, drops every centroid whose lower bound exceeds the smallest upper
bound, and compares the others by exact integer distances.  Bounds are
floating-point numbers and get a margin far above their rounding error, so
the result is that of comparing every centroid exactly.

A round reads the written table once; every task sends at most one partial
sum per centroid and component, so what reaches the driver is ``k * dims``
numbers whatever the table.  Memory of a task is bounded by its Arrow batch.

Defined results: vectors that are null, of another length than ``dims`` or
hold null or non-finite components take no part and give no row.  Each other
row is a vector of its own, repeated ids included.  Rows without an id are
chosen as starting centroids only after all others; equal hashes are ordered
by the vector.  With fewer than ``k`` vectors there are fewer centroids; an
empty table gives an empty result.  Components beyond +-2^27 after scaling
raise, since squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from increload.llm.common import stage

MAX_COMPONENT = 1 << 27
MARGIN = 1e-6  # of the squared distances involved; rounding stays below 1e-9 of them
FLATTEST = 1e-2  # least altitude of a pivot over the others, as a share of the base's size
ROWS = 8192


@dataclass(frozen=True)
class Clustering:
    """``assigned``: ``(id, cluster, distance, compared)`` per vector, where
    ``compared`` counts exact distances of the last assignment;
    ``centroids``: ``(cluster, members, cluster_inertia, components)``, empty
    clusters included; ``inertia``: sum of all distances."""

    assigned: DataFrame
    centroids: DataFrame
    inertia: int


class Simplex:
    """Apex coordinates over a base of pivots, from squared distances only."""

    def __init__(self, points: Sequence[Sequence[int]], pivots: int):
        rows = [np.array(p, dtype=np.int64) for p in points]
        self.pivots = rows[:1]
        self.base = np.zeros((0, 0))  # lower triangular: pivots 1, 2, ... seen from pivot 0
        rest = rows[1:]
        while rest and len(self.pivots) < pivots:
            apexes = self.apex(self.squared(np.array(rest)))
            best = int(np.argmax(apexes[:, -1]))  # the point that stands highest over the base
            if apexes[best, -1] <= FLATTEST * max(1.0, float(np.abs(apexes).max())):
                break
            n = len(self.base)
            grown = np.zeros((n + 1, n + 1))
            grown[:n, :n] = self.base
            grown[n] = apexes[best]
            self.base = grown
            self.pivots.append(rest.pop(best))

    def squared(self, values: np.ndarray) -> np.ndarray:
        """Squared distances of each row to each pivot: the cached distances."""
        return np.stack([exact(values, p) for p in self.pivots], axis=1)

    def apex(self, squared: np.ndarray) -> np.ndarray:
        """One coordinate per pivot after the first, then the altitude."""
        d = squared.astype(np.float64)
        n = len(self.base)
        out = np.zeros((len(d), n + 1))
        for i in range(n):  # forward substitution: 2 <x, p_i> = |x|^2 + |p_i|^2 - |x - p_i|^2
            p = self.base[i]
            out[:, i] = ((d[:, 0] + p @ p - d[:, i + 1]) / 2 - out[:, :i] @ p[:i]) / p[i]
        out[:, n] = np.sqrt(np.maximum(d[:, 0] - (out[:, :n] ** 2).sum(axis=1), 0.0))
        return out


def bounds(apexes: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lower and upper bounds of the distance of each row to each centre."""
    flat = ((apexes[:, None, :-1] - centres[None, :, :-1]) ** 2).sum(axis=2)
    a, c = apexes[:, None, -1], centres[None, :, -1]
    return flat + (a - c) ** 2, flat + (a + c) ** 2


def exact(values: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = values - centre
    return np.einsum("ij,ij->i", gap, gap)


def nearest(values: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centres: np.ndarray, measure: bool):
    """Number of the nearest centroid of each row (ties: the smaller number),
    its squared distance and how many centroids were compared exactly.
    Without ``measure`` a row whose bounds leave one centroid is not compared."""
    low, high = bounds(apexes, centres)
    size = (apexes**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] + 1.0
    margin = MARGIN * size
    open_ = low - margin <= (high + margin).min(axis=1)[:, None]
    n_open = open_.sum(axis=1)
    cluster = open_.argmax(axis=1)
    distance = np.full(len(values), np.iinfo(np.int64).max)
    ask = open_ if measure else open_ & (n_open > 1)[:, None]
    for j, centre in enumerate(centroids):
        rows = np.flatnonzero(ask[:, j])
        d = exact(values[rows], centre)
        better = d < distance[rows]
        cluster[rows[better]] = j
        distance[rows[better]] = d[better]
    return cluster, distance, ask.sum(axis=1)


def whole_numbers(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: float) -> DataFrame:
    """``(id, v array<int>)`` of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    usable = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    scaled = F.transform("x", lambda x: x * F.lit(float(scale)))
    fits = F.forall("s", lambda x: F.abs(x) <= F.lit(float(MAX_COMPONENT)))
    too_large = F.raise_error(F.lit("components of a vector are too large for exact distances")).cast("array<int>")
    return (
        rows.where((F.size("x") == dims) & usable)
        .select("id", scaled.alias("s"))
        .select("id", F.when(fits, F.transform("s", lambda x: F.floor(x).cast("int"))).otherwise(too_large).alias("v"))
    )


def _matrix(column: pa.Array, dims: int, dtype) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dims).astype(dtype)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def cluster_vectors(
    vectors: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1", dims: int = 64, pivots: int = 12,
    scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding",
) -> Clustering:
    """``rounds`` of assignment and replacement by componentwise ``floor(sum /
    count)``, then a last assignment.  Centroids start as the ``k`` vectors
    with the smallest sha256 of ``<seed>:<id>``; empty ones stay as they are."""
    spark = vectors.sparkSession
    data = whole_numbers(vectors, id_col, vec_col, dims, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = data.select(order.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    assigned_schema = "id long, cluster int, distance long, compared int"
    centroid_schema = "cluster int, members long, cluster_inertia long, components array<long>"
    if not first:
        return Clustering(spark.createDataFrame([], assigned_schema), spark.createDataFrame([], centroid_schema), 0)
    centroids = np.array([r["v"] for r in first], dtype=np.int64)
    simplex = Simplex(centroids, pivots)
    width = len(simplex.base) + 1

    def project(batches):
        for batch in _slices(batches):
            values = _matrix(batch.column("v"), dims, np.int64)
            apexes = simplex.apex(simplex.squared(values))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), _lists(apexes, pa.float64())], ["id", "v", "apex"])

    table = stage(data.mapInArrow(project, "id long, v array<int>, apex array<double>"), "apexes")

    def assigner(centroids: np.ndarray, last: bool):
        centres = simplex.apex(simplex.squared(centroids))

        def placed(batches):
            for batch in _slices(batches):
                values = _matrix(batch.column("v"), dims, np.int64)
                apexes = _matrix(batch.column("apex"), width, np.float64)
                yield batch, values, nearest(values, apexes, centroids, centres, measure=last)

        def rows(batches):
            for batch, _, (cluster, distance, compared) in placed(batches):
                columns = [batch.column("id"), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(compared, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance", "compared"])

        def sums(batches):
            count = np.zeros(len(centroids), dtype=np.int64)
            total = np.zeros((len(centroids), dims), dtype=np.int64)
            for _, values, (cluster, _, _) in placed(batches):
                count += np.bincount(cluster, minlength=len(count))
                for j in np.unique(cluster):
                    total[j] += values[cluster == j].sum(axis=0)
            met = np.flatnonzero(count)
            columns = [np.repeat(met, dims), np.tile(np.arange(dims), len(met)), np.repeat(count[met], dims), total[met].ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cluster", "dim", "n", "total"])

        return rows if last else sums

    for _ in range(rounds):
        parts = table.mapInArrow(assigner(centroids, last=False), "cluster long, dim long, n long, total long")
        whole = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        centroids = centroids.copy()
        for r in whole.collect():  # at most k * dims rows
            centroids[r["cluster"], r["dim"]] = int(r["total"]) // int(r["n"])

    assigned = stage(table.mapInArrow(assigner(centroids, last=True), assigned_schema), "assigned")
    per = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("d"))
    met = {r["cluster"]: (r["n"], r["d"]) for r in per.collect()}  # at most k rows
    rows = [(j, *met.get(j, (0, 0)), [int(x) for x in c]) for j, c in enumerate(centroids)]
    return Clustering(assigned, spark.createDataFrame(rows, centroid_schema), sum(d for _, d in met.values()))


def components_sha256(components: Sequence[int]) -> str:
    return hashlib.sha256(",".join(map(str, components)).encode()).hexdigest()
