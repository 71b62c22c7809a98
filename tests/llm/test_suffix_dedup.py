from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from increload.llm.suffix_dedup import SEGMENT, Shard, Winnower, _segments, common_prefixes, compare_pieces, joined_spans, kept_bytes, remove_repeats, suffix_array


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, sha256 of what stays) per text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(df):
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()]


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=200), st.text("ab", max_size=300).map(str.encode), st.text("\0\1", max_size=80).map(str.encode)), st.integers(1, 40))
def test_suffix_array_and_common_prefixes(data, cap):
    a = np.frombuffer(data, dtype=np.uint8)
    order, rank = suffix_array(a)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    assert (rank[order] == np.arange(len(data))).all()
    starts = np.arange(0, len(data), 17)
    got = common_prefixes(a, order, rank, starts, np.minimum(17, len(data) - starts), cap)
    for i, j in zip(order[:-1].tolist(), order[1:].tolist()):
        x, y = data[i:], data[j:]
        same = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert got[j] == min(same, cap)


def test_shards_are_merged_across_their_borders():
    rng = random.Random(2)
    for trial in range(60):
        rows = []
        for key in range(3):
            core = bytes(rng.choice(b"abc") for _ in range(25))
            made = {bytes(rng.choice(b"xy") for _ in range(rng.randrange(5))) + core + bytes(rng.choice(b"xy") for _ in range(rng.randrange(5))) for _ in range(rng.randrange(1, 14))}
            rows += [(key, p, p) for p in sorted(made)]
        for shard_bytes in (30, 90, 1 << 20):
            got = {(k, d): {i for s, e in r for i in range(s, e)} for k, d, r in compare_pieces(iter(rows), 24, shard_bytes)}
            for key, d, p in rows:
                want = {i for i in range(len(p) - 23) if any(p[i : i + 24] in q for k, _, q in rows if k == key and q != p)}
                assert got.get((key, d), set()) >= want
                for i in got.get((key, d), set()):  # nothing but true repeats
                    assert sum(q.count(p[i : i + 24]) for _, _, q in rows) > 1


def test_merge_by_binary_search_marks_both_sides():
    a, b = Shard([b"..shared-text.", b"only here a"], 8), Shard([b"shared-text!!", b"nothing else"], 8)
    assert not a.repeats.any() and not b.repeats.any()
    a.merge(b, b.windows(0, 1))
    assert [r for r in a.ranges()] == [[(2, 6)], []]
    assert [r for r in b.ranges()] == [[(0, 4)], []]


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(3)
    find = Winnower(100, 30)
    shared = rng.integers(97, 100, 150).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 123, n).astype(np.uint8), shared, rng.integers(97, 123, 40).astype(np.uint8)]) for n in (0, 13, 77)]
    chosen = []
    for t in texts:
        key, anchor, lo, hi = find.runs(t, np.array([0, len(t)]))
        assert (lo[1:] == hi[:-1] + 1).all() and lo[0] == 0 and hi[-1] == len(t) - 100
        at = bytes(t).index(bytes(shared))
        chosen.append([(int(key[i]), int(anchor[i]) - at) for p in range(at, at + 51) for i in [int(np.searchsorted(hi, p))]])
    assert chosen[0] == chosen[1] == chosen[2]


def test_long_texts_are_cut_into_overlapping_segments():
    offsets = np.cumsum([0, 10, 3 * SEGMENT + 5, 20, SEGMENT])
    windows = Counter()
    for first, start, cuts in _segments(offsets, 7):
        assert cuts[-1] - start <= 2 * SEGMENT
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            windows[(s, e - 7)] += 1
    covered = sorted(w for w in windows if w[1] > w[0])
    assert sum(e - s for s, e in covered) == sum(max(0, n - 7) for n in np.diff(offsets).tolist())


@given(st.binary(max_size=80), st.lists(st.tuples(st.integers(0, 60), st.integers(1, 6)), max_size=5), st.integers(1, 15))
def test_spans(text, runs, length):
    ranges = [{"start": s, "end": s + n} for s, n in runs if s + n + length - 1 <= len(text)]
    gone = {i for r in ranges for i in range(r["start"], r["end"] + length - 1)}
    spans = joined_spans(ranges, length)
    assert {i for s, e in spans for i in range(s, e)} == gone
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert kept_bytes(text, spans) == bytes(c for i, c in enumerate(text) if i not in gone)


def corpus(rng, alphabet):
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, copied = make(30), make(60)
    texts = [make(rng.randrange(0, 80)) for _ in range(40)]
    texts += [make(9) + passage + make(rng.randrange(20)) for _ in range(30)] + [copied] * 7
    texts += [copied[: rng.randrange(len(copied))] + make(3) for _ in range(8)]
    texts += ["ab" * 150, "a" * 333, "x" + "a" * 200, passage + passage, "", None, "é" * 70, "zé" * 40]
    return texts


@pytest.mark.parametrize("hot_kinds, shard_bytes", [(256, 1 << 20), (3, 1 << 20), (256, 300), (1, 64)])
def test_equals_brute_force(spark, hot_kinds, shard_bytes):
    texts = corpus(random.Random(hot_kinds), "abcdé日")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6, "doc_id")
    rows = remove_repeats(df, length=60, gram=20, shard_bytes=shard_bytes, hot_kinds=hot_kinds, with_kept=True).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert [got[i] for i in range(len(texts))] == brute(texts, 60)
    for r in rows:
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"]


def test_odd_rows(spark, odd_docs, no_docs):
    texts = [r["text"] for r in odd_docs.collect()]
    assert sorted(found(remove_repeats(odd_docs, length=100, gram=40))) == sorted(_by_pieces(texts, 100))
    assert remove_repeats(no_docs).collect() == []
    with pytest.raises(ValueError, match="gram"):
        remove_repeats(no_docs, length=10, gram=20)


def _by_pieces(texts, length):
    """:func:`brute` for long texts, by hashes of windows."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(hash(b[p : p + length]) for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        hit = [p for p in range(len(b) - length + 1) if seen[hash(b[p : p + length])] > 1]
        spans = joined_spans([{"start": p, "end": p + 1} for p in hit], length)
        out.append((len(b), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept_bytes(b, spans)).hexdigest()))
    return out


def test_a_phrase_in_every_document(spark):
    """A phrase shorter than a window makes one anchor of thousands of different pieces."""
    rng = random.Random(6)
    phrase = "the usual phrase that every page of this corpus repeats somewhere in its text"
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(60)) + phrase + "".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(1500)]
    texts += [texts[0][30:] + "!", "#" + texts[1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(df, length=100, gram=32, hot_kinds=64).collect()}
    assert [got[i] for i in range(len(texts))] == _by_pieces(texts, 100)


def test_a_text_longer_than_a_segment(spark):
    rng = np.random.default_rng(9)
    long_text = bytes(rng.integers(97, 123, SEGMENT + 300_000).astype(np.uint8)).decode()
    cut = SEGMENT - 150
    texts = [long_text, "--" + long_text[cut : cut + 500] + "--", "other " + long_text[100:700]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in remove_repeats(df, length=400).collect()}
    assert [(s["start"], s["end"]) for s in got[0]["spans"]] == [(100, 700), (cut, cut + 500)]
    assert [(s["start"], s["end"]) for s in got[1]["spans"]] == [(2, 502)]
    assert [(s["start"], s["end"]) for s in got[2]["spans"]] == [(6, 606)]
