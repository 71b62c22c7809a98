from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from increload.llm.packing import WordIds, pack, packed_sequences, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


@lru_cache
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def best_fit(lengths, window):
    """Best-fit decreasing, one piece at a time: the fills of the windows."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room[room.index(min(fits))] -= n
        else:
            room.append(window - n)
    return Counter(room)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_piecewise_best_fit(seed):
    rng = random.Random(seed)
    window = rng.choice([7, 64, 100, 256])
    lengths = [rng.randint(1, rng.choice([window, window // 3])) for _ in range(rng.randint(1, 700))]
    runs = plan(dict(Counter(lengths)), window)
    fill, taken = defaultdict(list), Counter()
    for length, first, pieces, sequence, each, offset in runs.itertuples(index=False):
        assert first == taken[length]
        taken[length] += pieces
        for i in range(pieces):
            fill[sequence + i // each].append((offset + i % each * length, length))
    assert taken == Counter(lengths)
    room = Counter()
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        room[window - at] += 1
    assert room == best_fit(lengths, window)


def check(rows, texts, window):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    for doc_id, (text, copies) in texts.items():
        ids = np.array(ids_of(text), dtype="<u4")
        pieces = Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[doc_id])
        want = Counter()
        for s in range(0, len(ids), window):
            part = ids[s : s + window]
            want[(s, len(part), zlib.crc32(part.tobytes()), len(ids))] += copies
        assert pieces == want
    lengths = [min(window, n - s) for text, copies in texts.values() for n in [len(ids_of(text))] for s in range(0, n, window) for _ in range(copies)]
    fills = Counter(window - sum(r["length"] for r in parts) for parts in by_seq.values())
    assert fills == best_fit(lengths, window)


@pytest.mark.parametrize("window", [64, 2048])
def test_documents(docs, window):
    texts = {r["doc_id"]: (r["text"], 1) for r in docs.collect()}
    check(pack(docs, PATH, window).collect(), texts, window)


def test_odd_documents(odd_docs, no_docs):
    rows = pack(odd_docs, PATH, 100).collect()
    got = Counter(r["doc_id"] for r in rows if r["start"] == 0)
    assert got == Counter(r["doc_id"] for r in odd_docs.collect())
    texts = {r["doc_id"]: (r["text"], 1) for r in odd_docs.where("doc_id is not null and doc_id != 8").collect()}
    texts[8] = ("one", 2)
    check(pack(odd_docs.where("doc_id is not null"), PATH, 100).collect(), texts, 100)
    assert pack(no_docs, PATH).collect() == []


def test_sequences_round_trip(docs):
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], dtype="<u4") for r in packed_sequences(docs, PATH, 512).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = defaultdict(list)
    for r in pack(docs, PATH, 512).collect():
        found[r["doc_id"]].append((r["start"], whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]))
    for doc_id, text in texts.items():
        ids = np.concatenate([p for _, p in sorted(found[doc_id], key=lambda x: x[0])])
        assert ids.tolist() == ids_of(text)


def test_split_at_white_space_changes_no_ids():
    coder = WordIds(tokenizer())
    assert coder.by_word
    texts = ["It's  a b　c\x1cd\n\t don't", "<|startoftext|> x<|endoftext|>y", "é ́x Σας ΣΑΣ İ", "a\x0bb\x0cc\x85d", "1234 !!a''s 're", ""]
    for text, got in zip(texts, coder.encode(texts), strict=True):
        assert [*np.frombuffer(got, dtype="<u4").tolist(), 1] == ids_of(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(max_codepoint=0x17F, exclude_categories=["Cs"]), st.sampled_from("'stremdvlAZ09 \n<|>́😀ǅΣ١"))), max_size=4))
def test_ids_equal_the_tokenizers(texts):
    coder = WordIds(tokenizer())
    for text, got in zip(texts, coder.encode(texts), strict=True):
        assert [*np.frombuffer(got, dtype="<u4").tolist(), 1] == ids_of(text)


def test_cache_generations(monkeypatch):
    from increload.llm import packing

    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    coder = WordIds(tokenizer())
    texts = [f"word{i % 7} Wörd{i % 5}, it's" for i in range(50)]
    for text, got in zip(texts, coder.encode(texts), strict=True):
        assert [*np.frombuffer(got, dtype="<u4").tolist(), 1] == ids_of(text)
    assert max(len(coder), len(coder.old), len(coder.pieces)) <= 3


def test_other_tokenizers_encode_whole_texts():
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder = WordIds(other)
    assert not coder.by_word
    (got,) = coder.encode(["two  spaces\n here"])
    assert np.frombuffer(got, dtype="<u4").tolist() == other.encode("two  spaces\n here", add_special_tokens=False).ids


def test_word_cache_is_bounded_and_shared(monkeypatch):
    monkeypatch.setattr("increload.llm.packing.CACHE_WORDS", 100)
    words = WordIds(tokenizer())
    rng = random.Random(3)
    plain = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    texts = [f"{w} {w.upper()} {w}. {w}--{v} É{w}é 's -- {w}'s" for w, v in zip(plain, reversed(plain))]
    most = 0
    for text in texts:
        assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == ids_of(text)[:-1]
        held = [d for k, d in vars(words).items() if isinstance(d, dict) and k != "letters"]
        most = max(most, len(words) + sum(map(len, held)))
    assert 100 < most <= 200  # two generations, whatever holds them
