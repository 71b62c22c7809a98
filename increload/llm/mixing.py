"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target is its weighted share of all words, at most ``max_rate``
times its own size, with the excess reshared by weight.  A document is taken
``floor(rate)`` times for certain, and once more with probability
``rate - floor(rate)``.  These fractional parts are rounded dependently: two
documents transfer mass, in a random direction that keeps both expectations,
until one of them is certain, and the other goes on to the next pairing.  The
words taken by a source therefore miss its target by less than one document,
and not by the sum of independent errors.

The pairing runs as a reduction tree: groups of at most ``GROUP`` documents
are folded to one open document each, the open documents of all groups form
the next level, and so on until each source has one left.  The random numbers
are hashes of ids and texts, so reruns agree.

Defined results: a null or wordless text has size 0, is kept once and takes
no words.  Null is a source of its own, ordered last.  Rows equal in id and
text are interchangeable.  An empty table gives an empty result.  Extra
columns are kept by ``mix_sources`` and ignored by ``mix_decisions``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from increload.llm.common import KEY, WORD, row_key, stage

GROUP = 64
RANKED_ROWS = 2048  # rows ranked together when groups are formed


def source_targets(sizes: DataFrame, weights: Sequence[float], max_rate: float) -> DataFrame:
    """One row per source: ``src`` = (source, source_size, target, n)."""
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(position, F.lit(len(weights))) + 1)
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    totals = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_rate)))
    totals = stage(totals, "sources")  # one row per source
    first = totals.agg(F.sum("source_size"), F.sum("weight")).first()
    total = float(first[0] or 0)
    level, capped = total / first[1] if first[1] else 0.0, 0
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap")
        row = totals.agg(
            F.count_if(above), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if row[0] == capped or not row[2]:
            break
        capped, level = row[0], (total - row[1]) / row[2]
    target = F.when(above, F.col("cap")).otherwise(F.col("weight") * F.lit(level))
    return totals.select("source", F.struct("source", "source_size", target.alias("target"), "n").alias("src"))


def _uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) made from the hash of ``cols``."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / F.lit(float(1 << 53))


def _unit(u: Column, p: Column) -> Column:
    return F.struct(u["doc_id"].alias("doc_id"), u["th"].alias("th"), u["size"].alias("size"), u["base"].alias("base"), p.alias("p"))


def _decided(u: Column, more: int) -> Column:
    return F.struct(u["doc_id"].alias("doc_id"), u["th"].alias("th"), u["size"].alias("size"), (u["base"] + F.lit(more)).alias("copies"))


def _pair(seed: int):
    """One pairing: the open document ``a`` meets ``b``; one of them becomes certain."""

    def step(acc: Column, b: Column) -> Column:
        a = acc["open"]
        mass_a, mass_b = a["size"] * a["p"], b["size"] * b["p"]
        room_a, room_b = a["size"] - mass_a, b["size"] - mass_b
        from_a, from_b = F.least(mass_a, room_b), F.least(mass_b, room_a)
        u = _uniform(seed, a["doc_id"], a["th"], b["doc_id"], b["th"])
        a_gives = u * (from_a + from_b) < from_b
        a_empties, b_empties = a_gives & (mass_a <= room_b), ~a_gives & (mass_b <= room_a)
        open_ = (
            F.when(a_empties, _unit(b, (mass_b + mass_a) / b["size"]))
            .when(a_gives, _unit(a, (mass_a - room_b) / a["size"]))
            .when(b_empties, _unit(a, (mass_a + mass_b) / a["size"]))
            .otherwise(_unit(b, (mass_b - room_a) / b["size"]))
        )
        certain = F.when(a_empties, _decided(a, 0)).when(a_gives, _decided(b, 1)).when(b_empties, _decided(b, 0))
        return F.struct(open_.alias("open"), F.concat(acc["done"], F.array(certain.otherwise(_decided(a, 1)))).alias("done"))

    return step


def _reduce_level(units: DataFrame, seed: int) -> DataFrame:
    """Fold groups of at most ``GROUP`` units of one source: ``(src, n, open, done)``."""
    subs = F.ceil(F.col("n") / F.lit(RANKED_ROWS))
    key = F.xxhash64(F.lit(seed), "u.doc_id", "u.th")
    ranked = units.withColumn("sub", F.pmod(key, subs)).withColumn(
        "rn", F.row_number().over(Window.partitionBy("src", "n", "sub").orderBy(key, "u.doc_id", "u.th")) - 1
    )
    groups = ranked.groupBy("src", "n", "sub", F.floor(F.col("rn") / F.lit(GROUP)).alias("g")).agg(
        F.array_sort(F.collect_list(F.struct("rn", "u"))).alias("units")
    )
    units_ = F.transform("units", lambda x: x["u"])
    none = F.expr("cast(array() as array<struct<doc_id:bigint,th:bigint,size:bigint,copies:bigint>>)")
    start = F.struct(F.element_at(units_, 1).alias("open"), none.alias("done"))
    rest = F.slice(units_, F.lit(2), F.size("units"))
    left = (F.ceil(F.col("n") / F.lit(GROUP)) + subs).alias("n")
    return groups.select("src", left, F.aggregate(rest, start, _pair(seed)).alias("f")).select("src", "n", "f.*")


def mix_decisions(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_rate: float = 3.0, seed: int = 42) -> DataFrame:
    """``(doc_id, th, source, size, source_size, target, copies, taken)`` per row of ``docs``."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("source").cast("string").alias("source"), size.alias("size")
    )
    sizes = stage(sizes, "sizes")
    src = source_targets(sizes, weights, max_rate).select(F.struct("source").alias("s"), "src")
    rate = F.when(F.col("src.source_size") > 0, F.col("src.target") / F.col("src.source_size")).otherwise(F.lit(0.0))
    rated = sizes.withColumn("s", F.struct("source")).join(src, "s").withColumn("rate", rate)
    base = F.floor("rate").cast("long")
    rated = rated.select("src", F.struct("doc_id", "th", "size", base.alias("base"), (F.col("rate") - F.floor("rate")).alias("p")).alias("u"))
    rated = stage(rated, "rated")

    unit = F.col("u")
    open_ = (unit["size"] > 0) & (unit["p"] > 0)
    copies = F.when(unit["size"] > 0, unit["base"]).otherwise(F.lit(1)).cast("long")
    parts = [rated.where(~open_).select("src", "u.doc_id", "u.th", "u.size", copies.alias("copies"))]
    units = rated.where(open_).select("src", F.col("src.n").alias("n"), "u")
    while True:
        level = stage(_reduce_level(units, seed), "level")
        parts.append(level.select("src", F.explode("done").alias("d")).select("src", "d.doc_id", "d.th", "d.size", "d.copies"))
        if level.groupBy("src").count().where("count > 1").isEmpty():
            break
        units = level.select("src", "n", F.col("open").alias("u"))
    last = F.col("open")
    more = (_uniform(seed, last["doc_id"], last["th"]) < last["p"]).cast("long")
    parts.append(level.select("src", "open.doc_id", "open.th", "open.size", (last["base"] + more).alias("copies")))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select(
        "doc_id", "th", "src.source", "size", "src.source_size", "src.target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_rate: float = 3.0, seed: int = 42) -> DataFrame:
    """``docs`` with every document repeated as often as the mix takes it."""
    chosen = mix_decisions(docs, weights, max_rate, seed)
    total = chosen.groupBy(F.struct(F.col("doc_id").alias("id"), "th").alias(KEY)).agg(F.sum("copies").alias("__llm_copies"))
    keyed = docs.withColumn(KEY, row_key(F.col("doc_id"), F.col("text"))).dropDuplicates([KEY])
    taken = keyed.join(total.where("__llm_copies > 0"), KEY)
    repeat = F.explode(F.sequence(F.lit(1), F.col("__llm_copies")))
    return taken.withColumn("__llm_copy", repeat).select(*[F.col(f"`{c}`") for c in docs.columns])
