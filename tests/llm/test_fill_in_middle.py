from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from increload.llm.fill_in_middle import ExceptionIndex, fill_in_middle, restored, transform_texts

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, seed="42", rate=50, spm_rate=80, unit="token"):
    text = text or ""
    units = TOKEN.findall(text) if unit == "token" else list(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def direct(texts, unit="token", rate=100):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    rows = transform_texts(list(range(len(texts))), np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, "42", rate, 80, unit)
    return [(*r[:5], r[5].decode()) for r in rows]


odd_text = st.text(st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1cab<>PSM.é€😀  "), st.characters(codec="utf-8")), max_size=60)


@given(st.lists(odd_text, min_size=1, max_size=8), st.sampled_from(["token", "char"]))
def test_equals_brute_force(texts, unit):
    assert direct(texts, unit) == [brute(i, t, rate=100, unit=unit) for i, t in enumerate(texts)]


@given(odd_text)
def test_index_converts_both_ways(text):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    index = ExceptionIndex(data)
    assert len(index.at) == sum(c > "\x7f" for c in text)
    cuts = np.arange(len(text) + 1)
    at = np.array([len(text[:c].encode()) for c in cuts])
    assert (index.bytes(cuts) == at).all() and (index.chars(at) == cuts).all()


def test_documents(spark, docs):
    got = {r["doc_id"]: tuple(r)[:6] for r in fill_in_middle(docs).collect()}
    want = {r["doc_id"]: brute(r["doc_id"], r["text"]) for r in docs.collect()}
    assert got == want
    assert {r[2] for r in want.values()} == {"plain", "spm", "psm"}


@pytest.mark.parametrize("unit", ["token", "char"])
def test_every_form_is_restored(spark, unit):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(["a", " ", "\n", "<", "S", ">", "é", "😀", "word "]) for _ in range(rng.randrange(60)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = fill_in_middle(df, rate=90, spm_rate=50, unit=unit)
    back = {r["doc_id"]: (r["form"], r["t"]) for r in out.select("doc_id", "form", restored(F.col("output"), F.col("form")).alias("t")).collect()}
    assert {i: t for i, (_, t) in back.items()} == dict(rows)
    assert {f for f, _ in back.values()} == {"plain", "spm", "psm"}


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted((tuple(r) for r in fill_in_middle(odd_docs, rate=100).collect()), key=repr)
    want = sorted((brute(r["doc_id"], r["text"], rate=100) for r in odd_docs.collect()), key=repr)
    assert got == want
    assert fill_in_middle(no_docs).collect() == []
    with pytest.raises(ValueError, match="unit"):
        fill_in_middle(odd_docs, unit="line")


def test_texts_longer_than_a_slice(spark):
    rng = random.Random(4)
    long_text = " ".join(rng.choice(["wörter", "of", "größe", "日本", "x"]) for _ in range(1_200_000))
    rows = [(1, "short é"), (2, long_text), (3, long_text[:-1]), (4, ""), (5, "tail ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: tuple(r) for r in fill_in_middle(df, rate=100).collect()}
    assert got == {i: brute(i, t, rate=100) for i, t in rows}
