"""Sharding along a Hilbert curve over document metadata.

Language, source and length are quantised to equally filled bins, a document's
cell is numbered along the Hilbert curve through the bins, and the order by
that number is cut into runs of equal row counts.  Neighbours on the curve are
neighbours in every dimension, so a shard covers a small box of each and files
can be pruned by filters on any of them.

The order is never sorted as a whole: rows are ranked within a cell (a cell
with very many rows is divided by a hash of the row first), and the positions
of the cells come from their counts, of which there are at most
``2 ** (3 * BITS)`` plus 1024 or one per ``RANKED_ROWS`` rows.

Defined results: a null text has size 1 and the checksum of the empty text;
null language, source or length sort first.  Every row gets a place, repeated
rows and rows without an id too.  Extra columns are ignored.  An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from increload.llm.common import KEY, stage, text_or_empty

BITS = 5
MICRO = 4096  # bins of the histogram from which equally filled bins are cut
RANKED_ROWS = 65536  # rows of a cell ranked by one task, at most
DIMS = ("lang", "source", "n_chars")


def _order_code(name: str) -> Column:
    """A long that orders like the number column: its logarithm."""
    c = F.col(name)
    return F.coalesce(F.floor(F.log2(F.greatest(c.cast("double"), F.lit(0.0)) + 1) * 1000), F.lit(-1)).cast("long")


def hilbert_index(q: Column, bits: int, dims: int) -> Column:
    """Position on the Hilbert curve of the bin numbers in the array ``q``
    (axes to transposed index by bit exchanges, then Gray code, then interleaving)."""
    levels = [1 << j for j in range(bits - 1, 0, -1)]
    steps = F.array(*[F.struct(F.lit(lv).alias("q"), F.lit(i).alias("i")) for lv in levels for i in range(dims)])

    def exchange(x: Column, s: Column) -> Column:
        low = s["q"] - 1
        swap = (x[0].bitwiseXOR(x[s["i"]])).bitwiseAND(low)
        flipped = F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
        swapped = F.transform(x, lambda v, j: F.when((j == 0) | (j == s["i"]), v.bitwiseXOR(swap)).otherwise(v))
        return F.when(x[s["i"]].bitwiseAND(s["q"]) != 0, flipped).otherwise(swapped)

    def gray(x: Column, i: Column) -> Column:
        return F.transform(x, lambda v, j: F.when(j == i, v.bitwiseXOR(x[i - 1])).otherwise(v))

    def toggle(acc: Column, lv: Column) -> Column:
        t = F.when(acc["x"][dims - 1].bitwiseAND(lv) != 0, acc["t"].bitwiseXOR(lv - 1)).otherwise(acc["t"])
        return F.struct(acc["x"].alias("x"), t.alias("t"))

    def interleave(acc: Column, s: Column) -> Column:
        bit = F.when(acc["x"][s["i"]].bitwiseAND(s["q"]) != 0, F.lit(1)).otherwise(F.lit(0))
        return F.struct(acc["x"].alias("x"), (acc["h"] * 2 + bit).cast("long").alias("h"))

    x = F.aggregate(steps, q, exchange) if levels else q
    x = F.aggregate(F.array(*[F.lit(i) for i in range(1, dims)]), x, gray)
    if levels:
        x = F.aggregate(
            F.array(*[F.lit(lv) for lv in levels]), F.struct(x.alias("x"), F.lit(0).alias("t")), toggle,
            lambda acc: F.transform(acc["x"], lambda v: v.bitwiseXOR(acc["t"])),
        )
    order = F.array(*[F.struct(F.lit(1 << j).alias("q"), F.lit(i).alias("i")) for j in range(bits - 1, -1, -1) for i in range(dims)])
    return F.aggregate(order, F.struct(x.alias("x"), F.lit(0).cast("long").alias("h")), interleave, lambda acc: acc["h"])


def equal_bins(histogram: dict[int, int], bins: int) -> list[int]:
    """Values at which a new bin begins, so that each bin holds about the same number of rows."""
    total, before, last, cuts = sum(histogram.values()), 0, 0, []
    for value in sorted(histogram):
        bin_ = before * bins // total
        if bin_ > last:
            cuts.append(value)
            last = bin_
        before += histogram[value]
    return cuts


def string_bin(rows: DataFrame, name: str, bins: int) -> Column:
    """The bin of a string column, by counts of whole values: nulls have the
    first bin for themselves, each value has its own while there are enough, and
    otherwise the bins hold about the same number of rows.

    The running sum over the distinct values, in order, is taken per range of
    values and shifted by the sums of the smaller ranges.
    """
    counts = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    valued = counts.where(F.col(name).isNotNull()).repartitionByRange(name).withColumn("sub", F.spark_partition_id())
    valued = stage(valued, f"values_{name}")
    nulls = int(not rows.where(F.col(name).isNull()).isEmpty())
    sums = valued.groupBy("sub").agg(F.sum("n").alias("n"))
    before = Window.orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    size = valued.agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows")).first()
    if size["values"] <= bins - nulls:
        firsts = [r[0] for r in valued.select(name).collect()]  # at most ``bins``
    else:
        inner = F.sum("n").over(Window.partitionBy("sub").orderBy(name).rowsBetween(Window.unboundedPreceding, -1))
        placed = valued.withColumn("inner", F.coalesce(inner, F.lit(0))).join(F.broadcast(sums), "sub")
        bin_ = F.floor((F.col("base") + F.col("inner")) * F.lit(bins - nulls) / F.lit(size["rows"]))
        firsts = [r["first"] for r in placed.groupBy(bin_.alias("bin")).agg(F.min(name).alias("first")).collect()]
    at = sum(((F.col(name) >= F.lit(v)).cast("int") for v in firsts), F.lit(nulls - 1))
    return F.coalesce(at, F.lit(0))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``(doc_id, size, text_crc32, curve, shard, slot)`` per row of ``docs``.

    Shard sizes in rows differ by at most one; ``slot`` numbers a shard's rows
    from 0 along the curve.
    """
    text = text_or_empty()
    codes = [(_order_code(c) if c == "n_chars" else F.col(c).cast("string")).alias(f"c{i}") for i, c in enumerate(DIMS)]
    size = (F.octet_length(text) + 1).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), *codes)
    rows = stage(rows, "rows")
    n = len(DIMS)
    length = DIMS.index("n_chars")
    ends = rows.agg(F.count(F.lit(1)), F.min(f"c{length}"), F.max(f"c{length}")).first()
    total = ends[0]
    if not total:
        return rows.select("doc_id", "size", "text_crc32", *[F.lit(0).cast(t).alias(c) for c, t in (("curve", "long"), ("shard", "int"), ("slot", "long"))])

    low, high = ends[1], ends[2]
    micro = F.floor((F.col(f"c{length}") - F.lit(low)).cast("double") * F.lit((MICRO - 1) / max(1, high - low))).cast("int")
    # At most MICRO counts.
    histogram = {r["m"]: r["n"] for r in rows.groupBy(micro.alias("m")).agg(F.count(F.lit(1)).alias("n")).collect()}
    by_length = sum(((micro >= F.lit(c)).cast("int") for c in equal_bins(histogram, 1 << BITS)), F.lit(0))
    bins = [(by_length if i == length else string_bin(rows, f"c{i}", 1 << BITS)).alias(f"q{i}") for i in range(n)]
    names = [f"q{i}" for i in range(n)]
    binned = rows.select("doc_id", "size", "text_crc32", *bins)
    cells = binned.groupBy(*names).agg(F.count(F.lit(1)).alias("__llm_cell_rows"))
    cells = stage(cells.withColumn("curve", hilbert_index(F.array(*names), BITS, n)), "cells")
    # At most 2 ** (BITS * n) = 32768 cells, so the broadcast has a fixed bound.
    placed = binned.join(F.broadcast(cells), names)
    ranked_rows = min(RANKED_ROWS, max(256, total // 1024))
    sub = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.ceil(F.col("__llm_cell_rows") / F.lit(ranked_rows)))
    placed = placed.select("doc_id", "size", "text_crc32", "curve", sub.alias("sub"))

    runs = placed.groupBy("curve", "sub").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("curve", "sub").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("curve", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("curve", "sub").orderBy("doc_id", "text_crc32", "size")) - 1
    ranked = placed.withColumn("rn", rank).join(runs, ["curve", "sub"]).withColumn("position", F.col("base") + F.col("rn"))
    shard = F.expr(f"cast((position * {shards}) div {total} as int)")
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", "curve", "shard", (F.col("position") - first).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write ``docs`` as one directory per shard, rows along the curve, so that
    Parquet's column ranges prune on language, source and length."""
    places = shard_documents(docs.select("doc_id", "text", *DIMS), shards)
    crc = F.crc32(text_or_empty())
    place = places.groupBy(F.struct(F.col("doc_id").alias("id"), F.col("text_crc32").alias("th")).alias(KEY)).agg(
        F.min("curve").alias("__llm_curve"), F.min("shard").alias("shard")
    )
    keyed = docs.withColumn(KEY, F.struct(F.col("doc_id").cast("long").alias("id"), crc.alias("th")))
    rows = keyed.join(place, KEY).drop(KEY)
    rows.repartitionByRange(shards, "shard", "__llm_curve").sortWithinPartitions("shard", "__llm_curve").drop(
        "__llm_curve"
    ).write.partitionBy("shard").parquet(path)
