from __future__ import annotations

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from increload.llm.line_dedup import boilerplate_lines, line_table, remove_boilerplate


def bare(line):
    return re.sub(r"[\t\r\x0b\x0c]", " ", line).strip(" ")


def plain(rows, min_sites):
    """Multiset of (doc_id, text after, lines, lines removed)."""
    sites, places = defaultdict(set), defaultdict(list)
    for i, text, site in rows:
        for n, line in enumerate((text or "").split("\n") if text is not None else []):
            if bare(line):
                sites[bare(line)].add(site)
                places[bare(line)].append((i is None, i or 0, text, n))
    first = {b: min(p) for b, p in places.items()}
    out = Counter()
    for i, text, _ in rows:
        if text is None:
            out[(i, None, 0, 0)] += 1
            continue
        lines = text.split("\n")
        kept = [
            line for n, line in enumerate(lines)
            if not bare(line) or len(sites[bare(line)]) < min_sites or (i is None, i or 0, text, n) == first[bare(line)]
        ]
        out[(i, "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    return out


def result(df, **kw):
    out = remove_boilerplate(df, stats=True, **kw)
    return Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect())


def test_documents(docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    for min_sites in (2, 5):
        assert result(docs, min_sites=min_sites) == plain(rows, min_sites)


def test_many_sites_around_the_threshold(spark):
    """Line k stands on k sites: estimates near the threshold must become exact."""
    rows = [(k * 1000 + s, f"own {k} {s}\nline {k}\n  line {k}\t\n", f"s{s}") for k in range(1, 70) for s in range(k)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for min_sites in (3, 40):
        assert result(df, min_sites=min_sites) == plain(rows, min_sites)


def test_spread_is_exact_near_the_threshold(spark):
    rows = [(k * 1000 + s, f"line {k}", f"s{s}") for k in range(35, 45) for s in range(k)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = boilerplate_lines(line_table(df, "source"), 40).collect()
    assert sorted(r["n_sites"] for r in found) == [40, 41, 42, 43, 44]


def test_odd_documents(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()]
    got = result(odd_docs, min_sites=2)
    want = plain(rows, 2)
    # A line first seen in two texts of one id, or without any id, may stay in either.
    assert got == want
    assert remove_boilerplate(odd_docs).columns == odd_docs.columns
    assert remove_boilerplate(no_docs).collect() == []


def test_hot_line_is_combined_before_the_shuffle(spark):
    df = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit("same\nline").alias("text"), F.pmod("id", F.lit(7)).cast("string").alias("source")
    )
    out = remove_boilerplate(df, min_sites=5)
    assert out.where("text != ''").collect()[0]["doc_id"] == 0
    assert out.where("text = ''").count() == 19_999
