"""Embedding near-duplicates over a robust-pruned flat graph.

Distinct vectors are assigned to their nearest few centroids, which gives
overlapping shards; a shard that is still large is divided by a hash.  In each
part a flat proximity graph is built by robust pruning of each vector's
nearest ones.  A vector's adjacency lists from all its parts are united.
Each vector then searches every part of its own shard: greedy search from the
part's medoids, and from there on every node within the similarity threshold
is expanded until no new one turns up.  Every link is verified by its cosine
in double precision.  The recall is audited against brute force over all
vectors, for queries that grow with the root of their number and are drawn in
equal parts from strata by found links, so that rare links and small groups are
asked for too.  It is the least of the recall per link, per neighbour without
its copies, per query, and per query within each stratum of true neighbours
(there the upper end of its 95 % interval).
While it misses the target, overlap, beam and degree are doubled and the graph
built again; after ``RAISES`` times all vectors are compared block by block,
exactly.  While no asked vector has a link at all, more are asked, up to
``MOST_ASKED``; if none of so many has one, the table counts as free of links
but for those found (a share of linked vectors above 3 / ``MOST_ASKED`` would
have shown with 95 % certainty).

A link may be found from one end only.  It counts at both: a vector's links
are the more of those it finds and of those that find it, so links and
components tell of the same pairs.

Groups of copies do not become pairs: equal vectors are one node with a
weight, searches return counts, and of the links themselves each task returns
only a spanning forest.

Defined results: vectors that are null, empty, zero, or hold a null, NaN or
infinite component, or whose length is not the commonest one, link with
nothing.  Of several rows with one id, the smallest usable vector takes part.
Rows without an id form one row with a null id.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from increload.llm.common import matrix, stage
from increload.llm.components import components

SAMPLE_PER_CENTROID = 32
MAX_CENTROIDS = 2048  # with the sample below, the bound of what the driver holds
MAX_SAMPLE = 65536
BATCH = 512
RAISES = 3
EXACT_ROWS = 4096  # of a block in the exact comparison
MOST_ASKED = 4096  # queries of an audit, held by the driver and compared by brute force


def unit_rows(values: list | np.ndarray) -> np.ndarray:
    x = np.array(values, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps the squares of huge and tiny components finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(rounds):
        nearest = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def greedy(x: np.ndarray, adj: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int):
    """Best-first search of a batch of queries from the best of the nodes
    ``starts``: ``(visited, beam ids, beam similarities, expanded)``; a node is
    visited once its similarity is known."""
    b, n = len(queries), len(x)
    rows = np.arange(b)
    visited, expanded = np.zeros((b, n), dtype=bool), np.zeros((b, n), dtype=bool)
    ids = np.full((b, beam), -1)
    sims = np.full((b, beam), -np.inf)
    first = queries @ x[starts].T
    best = np.argsort(-first, axis=1, kind="stable")[:, :beam]
    ids[:, : best.shape[1]] = starts[best]
    sims[:, : best.shape[1]] = np.take_along_axis(first, best, axis=1)
    visited[:, starts] = True
    while len(rows):
        done = expanded[rows[:, None], np.maximum(ids[rows], 0)] | (ids[rows] < 0)
        open_sims = np.where(done, -np.inf, sims[rows])
        best = np.argmax(open_sims, axis=1)
        live = open_sims[np.arange(len(rows)), best] > -np.inf
        rows, best = rows[live], best[live]
        if not len(rows):
            break
        node = ids[rows, best]
        expanded[rows, node] = True
        near = adj[node]
        fresh = (near >= 0) & ~visited[rows[:, None], near]
        r, c = np.nonzero(fresh)
        visited[rows[r], near[r, c]] = True
        got = np.full(near.shape, -np.inf)
        got[r, c] = np.einsum("ij,ij->i", x[near[r, c]], queries[rows[r]])
        all_ids, all_sims = np.hstack([ids[rows], near]), np.hstack([sims[rows], got])
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[rows] = np.take_along_axis(all_ids, top, axis=1)
        sims[rows] = np.take_along_axis(all_sims, top, axis=1)
        ids[rows] = np.where(np.isneginf(sims[rows]), -1, ids[rows])
    return visited, ids, sims, expanded


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """For each node keep the nearest candidate, drop those that are ``alpha``
    times nearer to it than to the node, and go on; at most ``degree`` stay.
    A third of the places go to the nearest candidates whether dropped or not:
    around a vector with many noisy copies every copy is covered by the
    original, and without these links most would have no way in.  ``cand`` is
    padded with -1."""
    cand = np.sort(cand, axis=1)
    repeat = np.zeros_like(cand, dtype=bool)
    repeat[:, 1:] = cand[:, 1:] == cand[:, :-1]
    alive = (cand >= 0) & ~repeat & (cand != nodes[:, None])
    points = x[np.maximum(cand, 0)]
    dist = np.where(alive, 1.0 - np.einsum("bcd,bd->bc", points, x[nodes]), np.inf)
    between = 1.0 - np.einsum("bcd,bed->bce", points, points)
    out = np.full((len(nodes), degree), -1)
    rows = np.arange(len(nodes))
    nearest = dist.copy()
    for i in range(degree):
        choice = nearest if i < degree // 3 else dist
        pick = np.argmin(choice, axis=1)
        has = np.isfinite(choice[rows, pick])
        out[has, i] = cand[rows[has], pick[has]]
        # distances are squared chords, so alpha enters squared
        covered = alpha * alpha * between[rows, pick] <= dist
        dist[covered & has[:, None]] = np.inf
        dist[rows, pick] = nearest[rows, pick] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int, beam: int, alpha: float = 1.2, seed: int = 7) -> np.ndarray:
    """Adjacency of a part, at most ``2 * degree`` nodes each, padded with -1.

    Candidates are the ``beam`` nearest nodes of the part and a few random
    ones; robust pruning keeps ``degree`` of them.  A node that is among the
    nearest of others is also linked back to them, to the nearest ``degree``.
    """
    n = len(x)
    rng = np.random.default_rng(seed)
    out = np.full((n, degree), -1)
    batch = max(1, BATCH * 32 // max(32, beam))  # pruning holds the candidates' vectors
    for nodes in np.array_split(np.arange(n), math.ceil(n / batch)):
        sims = x[nodes] @ x.T
        sims[np.arange(len(nodes)), nodes] = -np.inf
        near = np.argpartition(-sims, min(beam, n) - 1, axis=1)[:, :beam]
        far = rng.integers(0, n, size=(len(nodes), degree // 2))
        out[nodes] = robust_prune(x, nodes, np.hstack([near, far]), alpha, degree)
    source, col = np.nonzero(out[:, : degree // 3] >= 0)
    target = out[source, col]
    closeness = np.einsum("ij,ij->i", x[source], x[target])
    order = np.lexsort((source, -closeness, target))
    return np.hstack([out, _padded(target[order], source[order], n, degree)])


def _padded(rows: np.ndarray, values: np.ndarray, n: int, width: int) -> np.ndarray:
    """Values per row (rows sorted) as an array padded with -1; of longer rows the first ``width``."""
    start = np.searchsorted(rows, np.arange(n))
    col = np.arange(len(rows)) - start[rows]
    out = np.full((n, min(width, int(col.max(initial=0)) + 1)), -1)
    ok = col < out.shape[1]
    out[rows[ok], col[ok]] = values[ok]
    return out


def medoids(x: np.ndarray, groups: int = 64) -> np.ndarray:
    """The nodes nearest to the centres of up to ``groups`` clusters of ``x``."""
    centres = fit_centroids(x, min(groups, len(x)))
    return np.unique(np.argmax(x @ centres.T, axis=0))


def range_search(x: np.ndarray, adj: np.ndarray, queries: np.ndarray, threshold: float, beam: int) -> np.ndarray:
    """Matrix of the nodes within ``threshold`` that each query finds."""
    visited, _, _, expanded = greedy(x, adj, medoids(x), queries, beam)
    found = np.zeros_like(visited)
    q, node = np.nonzero(visited)
    for at in range(0, len(q), 1 << 18):
        qs, ns = q[at : at + (1 << 18)], node[at : at + (1 << 18)]
        found[qs, ns] = np.einsum("ij,ij->i", queries[qs], x[ns]) >= threshold
    while True:
        q, node = np.nonzero(found & ~expanded)
        if not len(q):
            return found
        expanded[q, node] = True
        for at in range(0, len(q), 1 << 13):
            near = adj[node[at : at + (1 << 13)]]
            asks = np.repeat(q[at : at + (1 << 13)], near.shape[1])
            near = near.ravel()
            ok = near >= 0
            flat = np.unique(asks[ok] * len(x) + near[ok])
            qs, ns = np.divmod(flat, len(x))
            fresh = ~visited[qs, ns]
            qs, ns = qs[fresh], ns[fresh]
            visited[qs, ns] = True
            found[qs, ns] = np.einsum("ij,ij->i", queries[qs], x[ns]) >= threshold


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links ``a - b`` with the smallest node of its component."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            return names, names[label]
        label = new


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    x = F.col(vec_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    some = F.exists(x, lambda c: c != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~bad & some)
    v = F.transform(x, lambda c: c.cast("double"))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def _shards(nodes: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """``(shard, home, id, v, w)``: each node with its ``overlap`` nearest centroids."""

    def assign(batches):
        for rows in batches:
            if len(rows):
                sims = unit_rows(rows["v"].tolist()) @ centres.T
                near = np.argsort(-sims, axis=1, kind="stable")[:, :overlap]
                for i in range(near.shape[1]):
                    yield pd.DataFrame({"shard": near[:, i], "home": i == 0, "id": rows["id"], "v": rows["v"], "w": rows["w"]})

    return nodes.mapInPandas(assign, "shard int, home boolean, id long, v array<double>, w long")


LINKS = "id long, n long, m long, other long, by long"


def _found_links(ask_ids: np.ndarray, ask_w: np.ndarray, found, ids: np.ndarray, w: np.ndarray) -> pd.DataFrame:
    """What a task of ``_links`` or ``_exact_links`` returns, from matrices of
    the nodes that ``BATCH`` queries each have found."""
    if not len(ask_ids):
        return pd.DataFrame({"id": [], "n": [], "m": [], "other": [], "by": []}).astype("Int64")
    weights, numbers, left, right = [], [], [], []
    by = np.zeros(len(ids), dtype=np.int64)  # weight of those that find each node
    for s, hit in zip(range(0, len(ask_ids), BATCH), found, strict=True):
        r, c = np.nonzero(hit)
        other = ids[c] != ask_ids[s + r]
        r, c = r[other], c[other]
        weights.append(np.bincount(r, weights=w[c], minlength=len(hit)).astype(np.int64))
        numbers.append(np.bincount(r, minlength=len(hit)))
        by += np.bincount(c, weights=ask_w[s + r], minlength=len(ids)).astype(np.int64)
        left.append(ask_ids[s + r])
        right.append(ids[c])
    node, low = forest(np.concatenate(left), np.concatenate(right))
    tree = node != low
    return pd.concat([
        pd.DataFrame({"id": ask_ids, "n": np.concatenate(weights), "m": np.concatenate(numbers), "other": None, "by": None}).astype("Int64"),
        pd.DataFrame({"id": node[tree], "n": None, "m": None, "other": low[tree], "by": None}).astype("Int64"),
        pd.DataFrame({"id": ids[by > 0], "n": None, "m": None, "other": None, "by": by[by > 0]}).astype("Int64"),
    ])


def _links(nodes: DataFrame, centres: np.ndarray, overlap: int, threshold: float, shard_rows: int, degree: int, beam: int) -> DataFrame:
    """``(id, n, m, other, by)``: per node the weight and number of the neighbours it finds
    in a part, the links of the parts' spanning forests (``other``), and the weight of the
    nodes that find it in a part (``by``); the rest of a row is null."""
    members = stage(_shards(nodes, centres, overlap), "shards")
    sizes = members.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).cast("int").alias("parts"))
    # One row per centroid, at most MAX_CENTROIDS.
    members = members.join(F.broadcast(sizes), "shard")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")  # one type on both sides of the cogroup

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        adj = build_graph(unit_rows(rows["v"].tolist()), degree, beam)
        ids = rows["id"].to_numpy()
        return pd.DataFrame({"id": ids, "near": [ids[a[a >= 0]] for a in adj]})

    lists = members.select("shard", part, "id", "v").groupBy("shard", "part").applyInPandas(build, "id long, near array<long>")
    graph = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    joined = stage(members.join(graph, "id"), "graph")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    inside = joined.select("shard", part, F.explode(every).alias("asked"), "id", "v", "w", "near")
    asked = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int").alias("asked")
    asking = joined.where("home").select("shard", F.explode(every).alias("part"), asked, "id", "v", "w")

    def search(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asks.empty:
            return _found_links(np.empty(0, dtype=np.int64), [], [], [], [])  # an empty side may come without columns
        rows = rows.sort_values("id", kind="stable")
        ids, w, x = rows["id"].to_numpy(), rows["w"].to_numpy(), unit_rows(rows["v"].tolist())
        place = pd.Series(np.arange(len(ids)), index=ids)
        lengths = rows["near"].map(len).to_numpy()
        names = np.concatenate(rows["near"].tolist())
        local = place.reindex(names).to_numpy()
        at = np.repeat(np.arange(len(ids)), lengths)
        here = ~np.isnan(local)  # neighbours outside this part are searched in theirs
        adj = _padded(at[here], local[here].astype(np.int64), len(ids), int(lengths.max(initial=1)))
        ask_ids, q = asks["id"].to_numpy(), unit_rows(asks["v"].tolist())
        found = (range_search(x, adj, q[s : s + BATCH], threshold, beam) for s in range(0, len(q), BATCH))
        return _found_links(ask_ids, asks["w"].to_numpy(), found, ids, w)

    keys = ("shard", "part", "asked")
    return inside.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(search, LINKS)


def _exact_links(nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """What ``_links`` returns, by comparison of every block of nodes with every block."""
    blocks = math.ceil(n / EXACT_ROWS)
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    inside = nodes.select(block.alias("part"), F.explode(every).alias("asked"), "id", "v", "w")
    asking = nodes.select(F.explode(every).alias("part"), block.alias("asked"), "id", "v", "w")

    def search(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asks.empty:
            return _found_links(np.empty(0, dtype=np.int64), [], [], [], [])  # an empty side may come without columns
        x, q = unit_rows(rows["v"].tolist()), unit_rows(asks["v"].tolist())
        found = (q[s : s + BATCH] @ x.T >= threshold for s in range(0, len(q), BATCH))
        return _found_links(asks["id"].to_numpy(), asks["w"].to_numpy(), found, rows["id"].to_numpy(), rows["w"].to_numpy())

    keys = ("part", "asked")
    return inside.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(search, LINKS)


def _brute_counts(nodes: DataFrame, asked: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """``(id, n, m)``: links and neighbours of the asked nodes that have any, by
    comparison with every node."""
    q, ids = unit_rows(asked["v"].tolist()), asked["id"].to_numpy()

    def compare(batches):
        for rows in batches:
            if len(rows):
                hit = unit_rows(rows["v"].tolist()) @ q.T >= threshold
                hit &= rows["id"].to_numpy()[:, None] != ids[None, :]
                m, n = hit.sum(axis=0), rows["w"].to_numpy() @ hit
                yield pd.DataFrame({"id": ids[m > 0], "n": n[m > 0], "m": m[m > 0]})

    return nodes.mapInPandas(compare, "id long, n long, m long").groupBy("id").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).toPandas()


def _asked(nodes: DataFrame, counts: DataFrame, queries: int) -> pd.DataFrame:
    """``(id, v, n, m, share)``: about ``queries`` nodes, as many from each stratum
    by found neighbours, with what they found; ``share`` nodes stand behind each."""
    found = nodes.join(counts, "id", "left").select("id", "v", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "m")])
    found = found.withColumn("stratum", F.floor(F.log2(F.col("m") + 1)).cast("int"))
    sizes = {r["stratum"]: r["count"] for r in found.groupBy("stratum").count().collect()}
    quota = math.ceil(queries / len(sizes))
    share = F.create_map(*[F.lit(x) for st, size in sizes.items() for x in (st, max(1.0, size / quota))])[F.col("stratum")]
    draw = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))
    return found.withColumn("share", share).where(draw * F.col("share") < 1).select("id", "v", "n", "m", "share").toPandas()


def audited_recall(asked: pd.DataFrame, true: pd.DataFrame) -> float | None:
    """The least recall: per link, per neighbour, per query, and per query of each
    stratum of true neighbours.  A stratum counts with the upper end of its mean's
    95 % interval: few queries of many strata would else be below any target
    by chance.  None if no asked node has a link."""
    rows = asked.merge(true, on="id", suffixes=("", "_true"))
    if rows.empty:
        return None
    share = rows["share"].to_numpy()
    got, want = rows[["n", "m"]].to_numpy(dtype=np.float64), rows[["n_true", "m_true"]].to_numpy(dtype=np.float64)
    got = np.minimum(got, want)
    query = (got / want).min(axis=1)
    stratum = np.floor(np.log2(want[:, 1] + 1))
    recalls = [*(share @ got / (share @ want)), share @ query / share.sum()]
    for x in np.unique(stratum):
        here = query[stratum == x]
        mean = np.average(here, weights=share[stratum == x])
        recalls.append(min(1.0, mean + 1.64 * here.std() / math.sqrt(len(here))))
    return float(min(recalls))


def near_duplicate_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    threshold: float = 0.95,
    overlap: int = 2,
    shard_rows: int = 2048,
    degree: int = 24,
    beam: int = 32,
    audit: int = 256,
    target_recall: float = 0.95,
) -> DataFrame:
    """``(id_col, n_links, component_id, kept)``, one row per id."""
    usable = stage(_usable(vectors, id_col, vec_col), "usable")
    lengths = usable.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    shape = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    every = vectors.select(F.col(id_col).cast("long").alias(id_col)).distinct()
    if shape is None:
        return every.select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    usable = usable.where(F.size("v") == shape["d"])
    nodes = stage(usable.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")), "nodes")
    n = nodes.count()
    k = min(MAX_CENTROIDS, math.ceil(n * overlap / shard_rows))
    mixed = F.xxhash64("id", F.lit(2))
    sample = nodes.orderBy(mixed, "id").select("v").limit(min(MAX_SAMPLE, SAMPLE_PER_CENTROID * k)).toArrow()
    k = min(k, len(sample))
    centres = fit_centroids(unit_rows(matrix(sample, "v")), k)
    for _ in range(RAISES + 1):
        links = stage(_links(nodes, centres, min(overlap, k), threshold, shard_rows, degree, beam), "links")
        counts = links.where("n is not null").groupBy("id").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
        queries = min(MOST_ASKED, max(audit, math.ceil(4 * math.sqrt(n))))
        while True:
            asked = _asked(nodes, counts, queries)
            recall = audited_recall(asked, _brute_counts(nodes, asked, threshold)) if len(asked) else None
            if recall is not None or queries >= min(n, MOST_ASKED):
                break
            queries = min(MOST_ASKED, 4 * queries)
        if recall is None or recall >= target_recall:
            break
        overlap, degree, beam = 2 * overlap, 2 * degree, 2 * beam
    else:
        links = stage(_exact_links(nodes, n, threshold), "links")
    ends = links.groupBy("id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("by"), F.lit(0)).alias("by"))
    counts = ends.select("id", F.greatest("n", "by").alias("n"))
    roots = stage(components(links.where("other is not null"), "id", "other"), "roots")
    described = (
        nodes.join(counts, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
        .select("v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("root", "id").alias("root"))
    )
    rows = usable.join(described, "v").select(F.col("id").alias(id_col), "n", "root")
    root = F.coalesce("root", id_col)
    return every.join(rows, id_col, "left").select(
        id_col, F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), root.eqNullSafe(F.col(id_col)).alias("kept")
    )
