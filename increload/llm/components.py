"""Connected components of an edge table by alternating large and small stars.

Every step is a pre-aggregated minimum per node and a join back to the
edges, so a hub with any number of neighbours is combined map-side first and
its edges are spread by the join's skew handling.  The edge table is written
once per round to the shared checkpoint folder; only a count and a checksum
reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from increload.llm.common import stage


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return (row[0], row[1])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node that is not the smallest of its component.

    Self-loops, repeated and reversed edges are allowed; edges with a null
    end are ignored.  A node absent from the result is its own root.
    """
    u, v = F.col(a), F.col(b)
    e = edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    e = stage(e, "edges")
    seen = _fingerprint(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (
            small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = stage(small, "edges")
        now = _fingerprint(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
