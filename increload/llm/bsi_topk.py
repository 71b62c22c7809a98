"""Exact top-k by inner product over a bit-sliced index.

Every vector component is quantised to ``floor(scale * x)``.  The index holds,
per block of rows, one bitmap per component and bit.  A query adds the slices
of all components, weighted by the bits of its own components, with bitmap
carry-save adders; the result is the bit-sliced score of every row of the
block.  The best rows are then selected from the most significant slice
downward, and rows tied at the boundary are resolved by id, so the answer is
exact.

Defined results: vectors that are null, empty, or hold a null, NaN or infinite
component take no part, nor do rows without an id or vectors whose length is
not the commonest one (ties: the longer).  Of several rows with one id, the
one with the smallest quantised vector takes part.  An empty table gives an
empty result.  Scores that cannot fit a long raise ``ValueError``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from increload.llm.common import stage

INDEX_SCHEMA = "block long, ids binary, slices binary"


def quantise(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """``(id, v)``: usable vectors with components ``floor(scale * x)``."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    usable = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad)
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    return usable.select(F.col(id_col).cast("long").alias("id"), ints.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def build_slices(values: np.ndarray, low: int, bits: int) -> np.ndarray:
    """Bitmaps ``(dims * bits, words)`` of ``values - low``; row r is bit r % 64 of word r // 64."""
    n, dims = values.shape
    words = (n + 63) // 64
    padded = np.zeros((words * 64, dims), dtype=np.int64)
    padded[:n] = values - low
    out = np.empty((dims * bits, words), dtype=np.uint64)
    for j in range(bits):
        plane = ((padded >> j) & 1).astype(np.uint8)
        out[j::bits] = np.ascontiguousarray(np.packbits(plane.T, axis=1, bitorder="little")).view(np.uint64)
    return out


def _add_column(rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Carry-save addition of equally weighted bitmaps: their sum bit and the carries."""
    carries = []
    while len(rows) > 1:
        k = len(rows) // 3
        if k:
            a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
            x = a ^ b
            carries.append((a & b) | (x & c))
            rows = np.concatenate([x ^ c, rows[3 * k :]])
        else:
            carries.append((rows[0] & rows[1])[None])
            rows = (rows[0] ^ rows[1])[None]
    return rows[0], carries


def score_slices(slices: np.ndarray, negated: np.ndarray, query: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bit slices of the sum over components of ``|q| * u`` (``q`` positive) or
    ``|q| * (2**bits - 1 - u)`` (``q`` negative), least significant first."""
    dims = len(query)
    both = np.concatenate([slices, negated])
    first = np.arange(dims) * bits + np.where(query < 0, dims * bits, 0)
    size = np.abs(query)
    columns: list[list[np.ndarray]] = []
    for shift in range(int(size.max(initial=0)).bit_length()):
        used = first[(size >> shift) & 1 == 1]
        for j in range(bits):
            while len(columns) <= shift + j:
                columns.append([])
            if len(used):
                columns[shift + j].append(both[used + j])
    out, w = [], 0
    while w < len(columns):
        rows = np.concatenate(columns[w]) if columns[w] else np.zeros((1, slices.shape[1]), dtype=np.uint64)
        bit, carries = _add_column(rows)
        out.append(bit)
        if carries:
            if w + 1 == len(columns):
                columns.append([])
            columns[w + 1].extend(carries)
        w += 1
    return out


def select_top(score: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores among ``rows`` (a bitmap), ties to the smaller position."""
    def count(bitmap: np.ndarray) -> int:
        return int(np.bitwise_count(bitmap).sum())

    def positions(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    sure, open_ = np.zeros_like(rows), rows.copy()
    k = min(k, count(rows))
    for bit in reversed(score):
        ones = open_ & bit
        n = count(sure) + count(ones)
        if n > k:
            open_ = ones
        else:
            sure |= ones
            open_ &= ~bit
            if n == k:
                break
    head = positions(sure)
    return np.concatenate([head, positions(open_)[: k - len(head)]])


def search_block(ids: np.ndarray, slices: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, low: int, bits: int, k: int):
    """Top ``k`` rows of one block for each query: arrays (query id, row id, score)."""
    n = len(ids)
    valid = np.packbits(np.arange(slices.shape[1] * 64) < n, bitorder="little").view(np.uint64)
    negated = ~slices
    found_q, found_v, found_s = [], [], []
    for qid, q in zip(query_ids, queries, strict=True):
        score = score_slices(slices, negated, q, bits)
        rows = valid.copy()
        own = int(np.searchsorted(ids, qid))
        if own < n and ids[own] == qid:
            rows[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        pos = select_top(score, rows, k)
        total = np.zeros(len(pos), dtype=np.int64)
        for w, bit in enumerate(score):
            total += (((bit[pos >> 6] >> (pos & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)) << w
        total += int(q.sum()) * low + int(q[q < 0].sum()) * ((1 << bits) - 1)
        found_q.append(np.full(len(pos), qid, dtype=np.int64))
        found_v.append(ids[pos])
        found_s.append(total)
    empty = np.empty(0, dtype=np.int64)
    return tuple(np.concatenate(x) if x else empty for x in (found_q, found_v, found_s))


def bit_sliced_top_k(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: float = 64.0,
    block_rows: int = 32768,
    query_rows: int = 512,
) -> DataFrame:
    """The ``k`` best rows for every row that satisfies ``is_query(id column)``.

    Returns ``(query_id long, rank int, vec_id long, score long)``.  The index
    is cut into blocks of about ``block_rows`` rows and the queries into groups
    of about ``query_rows``; one task scores one group against one block, so a
    task's memory does not depend on the size of the table.
    """
    spark = vectors.sparkSession
    data = stage(quantise(vectors, id_col, vec_col, scale), "quantised")
    lengths = data.groupBy(F.size("v").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi")
    )
    shape = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, n, low, high = int(shape["d"]), int(shape["n"]), int(shape["lo"]), int(shape["hi"])
    bits = max(1, (high - low).bit_length())
    if dims * max(abs(low), abs(high), 1) * (abs(low) + (1 << bits)) >= 1 << 62:
        raise ValueError("scores of these vectors do not fit a long")
    data = data.where(F.size("v") == dims)
    blocks = math.ceil(n / block_rows)

    def index(batches):
        parts = [b for b in batches if len(b)]
        if parts:
            rows = pd.concat(parts).sort_values("id", kind="stable")
            values = np.array(rows["v"].tolist(), dtype=np.int64)
            slices = build_slices(values, low, bits)
            block = TaskContext.get().partitionId()
            yield pd.DataFrame({"block": [block], "ids": [rows["id"].to_numpy(np.int64).tobytes()], "slices": [slices.tobytes()]})

    indexed = stage(data.repartition(blocks).mapInPandas(index, INDEX_SCHEMA), "index")
    queries = data.where(is_query(F.col("id")))
    groups = max(1, math.ceil(queries.count() / query_rows))
    left = indexed.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )

    def search(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if block.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids = np.frombuffer(block["ids"].iloc[0], dtype=np.int64)
        slices = np.frombuffer(block["slices"].iloc[0], dtype=np.uint64).reshape(dims * bits, -1)
        q = np.array(asked["v"].tolist(), dtype=np.int64)
        found = search_block(ids, slices, asked["id"].to_numpy(np.int64), q, low, bits, k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    best = (
        left.groupBy("block", "g")
        .cogroup(right.groupBy("block", "g"))
        .applyInPandas(search, "query_id long, vec_id long, score long")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
