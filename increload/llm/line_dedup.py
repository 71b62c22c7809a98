"""Cross-site boilerplate lines by distinct-site spread.

A line that appears on many distinct sites is boilerplate.  The spread is
estimated with a HyperLogLog sketch of the sites per line hash; sketches are
built in each task and merged by aggregation, so a line that is on every page
is combined before the shuffle.  Lines whose estimate is close to the
threshold get an exact distinct count.  A boilerplate line is removed wherever
it stands but for its first occurrence (smallest ``doc_id``, then text hash,
then line number), so no passage is lost from the corpus.

Lines are compared without surrounding white space; blank lines are never
boilerplate.  Defined results: a null text stays null; rows without a site
count together as one site; rows without an id come last in the order of
occurrences.  Rows equal in id and text are treated alike.  Every row of the
input is returned, with its extra columns, also when no line of it is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from increload.llm.common import KEY, row_key, stage

LG_K = 8  # 256 registers; standard error 1.04 / 16
BAND = 0.25  # estimates within this share of the threshold are counted exactly (four standard errors)
HASH_2 = "second"  # lines are told apart by two 64-bit hashes


def _lines() -> Column:
    return F.split("text", "\n", -1)


def _bare(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\x0b\x0c", "    "))


def line_table(docs: DataFrame, site: str) -> DataFrame:
    """``(h1, h2, site, key, line)`` per non-blank line: hashes, site, row key, line number."""
    label = F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("-"))  # sketches skip empty strings
    rows = docs.where(F.col("text").isNotNull()).select(
        label.alias("site"), row_key(F.col("doc_id"), F.col("text")).alias("key"), F.posexplode(_lines()).alias("line", "raw")
    )
    bare = rows.select("site", "key", "line", _bare(F.col("raw")).alias("bare")).where("bare != ''")
    return bare.select(F.xxhash64("bare").alias("h1"), F.xxhash64(F.lit(HASH_2), "bare").alias("h2"), "site", "key", "line")


def boilerplate_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """``(h1, h2, n_sites, first)`` of the lines on at least ``min_sites``
    sites; ``n_sites`` is exact near the threshold and estimated above it.
    ``lines`` must be a written table: it is read twice."""
    place = F.struct(F.col("key.id").isNull().alias("no_id"), F.col("key.id").alias("id"), F.col("key.th").alias("th"), "line")
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(place).alias("first"))
    spread = spread.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("estimate"))
    spread = stage(spread.where(F.col("estimate") >= min_sites * (1 - BAND)), "spread")
    sure = spread.where(F.col("estimate") > min_sites * (1 + BAND)).select("h1", "h2", F.col("estimate").alias("n_sites"), "first")
    near = spread.where(F.col("estimate") <= min_sites * (1 + BAND))
    pairs = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("h1", "h2").agg(F.count("one").alias("n_sites")).where(F.col("n_sites") >= min_sites)
    return sure.unionByName(near.join(exact, ["h1", "h2"]).select("h1", "h2", "n_sites", "first"))


def removed_lines(docs: DataFrame, min_sites: int = 5, site: str = "source") -> DataFrame:
    """``(key, removed)``: the numbers of the lines that go, per affected row key."""
    lines = stage(line_table(docs, site), "lines")
    found = boilerplate_lines(lines, min_sites)
    hit = lines.join(found.select("h1", "h2", "first"), ["h1", "h2"])
    keeps = F.col("key.id").eqNullSafe(F.col("first.id")) & (F.col("key.th") == F.col("first.th")) & (F.col("line") == F.col("first.line"))
    gone = hit.where(~keeps)
    return gone.groupBy("key").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def remove_boilerplate(docs: DataFrame, min_sites: int = 5, site: str = "source", stats: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; ``stats`` adds
    ``n_lines`` and ``n_removed`` (long)."""
    gone = stage(removed_lines(docs, min_sites, site), "gone").select(F.col("key").alias(KEY), F.col("removed").alias("__llm_removed"))
    keyed = docs.withColumn(KEY, row_key(F.col("doc_id"), F.col("text"))).join(gone, KEY, "left")
    removed = F.col("__llm_removed")
    kept = F.filter(_lines(), lambda _, i: ~F.array_contains(removed, i))
    text = F.when(removed.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    extra = []
    if stats:
        n = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines())).cast("long")
        extra = [n.alias("n_lines"), F.coalesce(F.size("__llm_removed"), F.lit(0)).cast("long").alias("n_removed")]
    return keyed.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], *extra)
