"""From raw documents to packed training sequences.

Each stage takes the documents its predecessor kept, written as Parquet and
read again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from increload.llm.common import stage, table  # noqa: E402
from increload.llm.line_dedup import remove_boilerplate  # noqa: E402
from increload.llm.mixing import mix_sources  # noqa: E402
from increload.llm.packing import pack  # noqa: E402
from increload.llm.quality import keep_good  # noqa: E402
from increload.llm.simhash import drop_near_duplicates  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that spread over sites (the first occurrence of each stays)."""
    return remove_boilerplate(docs, min_sites=5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return drop_near_duplicates(docs, shingle=3, distance=3)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have their target shares."""
    return mix_sources(docs, weights=(5, 2, 1), max_rate=3.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows of 2048."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=2048)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("packing", packing)]

#: SQL expresses neither the trained classifier nor the hashes; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
