"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is the bitwise majority of the XXH64 hashes of a document's
word shingles.  Two fingerprints that differ in at most ``d`` bits, cut into
``b`` blocks, agree on at least ``b - d`` whole blocks, so they share one of
the ``C(b, d)`` keys made of ``b - d`` blocks.  Joining on these keys misses
no pair; the Hamming distance is then verified.

Groups of copies do not become pairs: equal fingerprints are one node, and in
each block bucket all nodes are first compared with the bucket's smallest
fingerprint only (a minimum, combined map-side).  The nodes so linked are
merged into components; the remaining comparisons are those between nodes of
one bucket that lie in different components, which is all that can still
change the result.

Defined results: a null text counts as empty; documents without words have
fingerprint zero and link like any other.  Each input row gives one row.  A
row without a ``doc_id`` can join documents but never names a component: the
component of rows that all lack an id is null.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from increload.llm.common import KEY, row_key, stage, text_or_empty
from increload.llm.components import components

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str, shingle: int) -> int:
    """Majority bits of the shingle hashes of one text, as an unsigned 64-bit number."""
    words = WORDS.findall(text.encode("utf-8").lower())  # bytes.lower() maps A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = starts + lengths
    if len(words) >= shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    total, ones = len(starts), np.zeros(64, dtype=np.int64)
    for at in range(0, total, CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(view[s:e], SEED) for s, e in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > total)))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``(doc_id, th, fp)`` per document row: id, hash of the text, signed fingerprint."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(fps)], ["doc_id", "th", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, fp long")


def block_keys(fp: Column, blocks: int, distance: int) -> Column:
    """Array of the keys of one fingerprint: which blocks, and their bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(number).cast("short").alias("c"), fp.bitwiseAND(F.lit(signed)).alias("b")))
    return F.array(*keys)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def blocks_for(nodes: int, distance: int) -> int:
    """Fewest blocks, two more than ``distance`` at least, whose keys are long
    enough that random fingerprints give each node at most about one candidate
    per key."""
    blocks = distance + 2
    while blocks < distance + 5 and (64 * (blocks - distance)) // blocks < nodes.bit_length():
        blocks += 1
    return blocks


def simhash_components(docs: DataFrame, shingle: int = 3, distance: int = 3, blocks: int | None = None) -> DataFrame:
    """``(doc_id, th, fp, root, component_id)`` for every row of ``docs``.

    ``root`` is the component's smallest fingerprint, ``component_id`` is the smallest ``doc_id`` reachable over links of at
    most ``distance`` differing bits.  ``blocks`` only trades the number of
    keys against their length; the result is the same for any value above
    ``distance``.
    """
    prints = stage(fingerprints(docs, shingle), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    blocks = blocks or blocks_for(nodes.count(), distance)
    keyed = nodes.select("fp", F.explode(block_keys(F.col("fp"), blocks, distance)).alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low != high")
    members = stage(keyed.join(buckets.select("key", "low"), "key").select("key", "low", "fp"), "members")

    stars = members.where((F.col("low") != F.col("fp")) & (hamming(F.col("low"), F.col("fp")) <= distance))
    merged = stage(components(stars, "low", "fp"), "merged")
    named = (
        members.select("key", "fp")
        .join(merged, F.col("fp") == F.col("node"), "left")
        .select("key", "fp", F.coalesce("root", "fp").alias("root"))
    )
    named = stage(named, "named")
    mixed = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    open_ = named.join(mixed, "key")
    a, b = open_.alias("a"), open_.alias("b")
    close = (F.col("a.root") < F.col("b.root")) & (hamming(F.col("a.fp"), F.col("b.fp")) <= distance)
    rest = a.join(b, (F.col("a.key") == F.col("b.key")) & close)
    rest = rest.select(F.col("a.root").alias("low"), F.col("b.root").alias("fp")).distinct()
    edges = merged.select(F.col("root").alias("low"), F.col("node").alias("fp")).unionByName(rest)
    roots = stage(components(edges, "low", "fp"), "roots")

    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = stage(rooted.join(names, "root").select("fp", "root", "component_id"), "by_fp")
    return prints.join(by_fp, "fp").select("doc_id", "th", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """``docs`` with one document of each component: the one whose id names it.

    Of rows equal in id and text one stays; a component without any id keeps
    the row with the smallest text hash.
    """
    groups = simhash_components(docs, shingle, distance)
    named = F.col("doc_id").eqNullSafe(F.col("component_id"))
    best = groups.groupBy("root").agg(F.min(F.when(named, F.struct(F.col("doc_id").alias("id"), "th"))).alias(KEY))
    keyed = docs.withColumn(KEY, row_key(F.col("doc_id"), F.col("text")))
    return keyed.join(best.select(KEY), KEY, "left_semi").dropDuplicates([KEY]).drop(KEY)
