"""Packing of tokenised documents into fixed windows, best-fit decreasing.

Documents are tokenised whole (ids of the given tokenizer, then one end
token).  Documents longer than a window are first cut into full windows.  The
remaining pieces are packed largest first, each into the tightest open window
that can take it, found by a segment tree over remaining capacities.

Piece lengths are whole numbers up to the window size, so the plan is made on
the histogram of lengths: equal pieces move in runs ("pieces 0..m of length s
go to windows w.. at offset o"), which gives exactly the result of placing
the pieces one by one, in memory bounded by the window size whatever the
number of documents.  Pieces then look up their place by their number within
their length.

Defined results: a null text counts as empty and gives the end token alone.
Every input row is packed, repeated rows and rows without an id too.  Extra
columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from increload.llm.common import gapless, stage, text_or_empty

END_ID = 1
CACHE_WORDS = 250_000  # about 50 MB a generation
CACHE_CHARS = 64  # longer stretches (paragraphs without spaces) are encoded each time
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sub int"


# How a tokenizer file says that it drops white space, lower-cases
# and encodes letters, single digits and runs of other characters apart.
WORD_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Stretches of printable ASCII and Latin-1 letters: nothing to compose, and
# lower-casing and classes of these characters are the same everywhere.
SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]*")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary:
    printable Latin-1 for itself, the others 256, 257, ... in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds(dict):
    """Token ids (little-endian bytes) of white-space-free stretches of text.

    A tokenizer that drops white space never joins text across it, so a
    text's ids are those of its stretches one after another.  Frequent
    stretches of up to ``CACHE_CHARS`` are looked up, and so are the pieces of
    others (a piece by itself is a stretch with the same ids); two generations
    of at most ``CACHE_WORDS`` are kept.  Other tokenizers encode whole texts.
    """

    def __init__(self, tokenizer):
        super().__init__()
        config = json.loads(tokenizer.to_str())
        split = (config["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.by_word = (
            (config["normalizer"] or {}).get("normalizers") == WORD_NORMALIZER
            and split[0].get("pattern") == {"Regex": WORD_PATTERN}
            and [p["type"] for p in split] == ["Split", "ByteLevel"]
            and config["post_processor"] is None
        )
        self.tokenizer, self.model = tokenizer, tokenizer.model
        special = [re.escape(t["content"]) for t in config["added_tokens"]]
        self.special = re.compile("|".join(special) or r"(?!)")
        self.letters = byte_letters()
        self.old: dict[str, bytes] = {}

    @property
    def pieces(self) -> dict[str, bytes]:
        """Pieces have no cache of their own: they are held as stretches."""
        return self

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._encode(word)
        if len(word) > CACHE_CHARS:
            return ids
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _encode(self, word: str) -> bytes:
        low = word.lower()
        if word.isascii():
            if low.isalpha():
                return self._piece(word) if low == word else self[low]
            if low[:-1].isalpha() and low[-1] in ".,":
                return self[low[:-1]] + self[low[-1]]
        if not SIMPLE.fullmatch(word) or self.special.search(word):
            return _as_bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)
        pieces = PIECE.findall(low)
        return self._piece(word) if pieces == [word] else b"".join(map(self.__getitem__, pieces))

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return _as_bytes([t.id for t in self.model.tokenize(spelled)])

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [_as_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [b"".join(map(self.__getitem__, spaced(t).split(" "))) for t in texts]


def spaced(text: str) -> str:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")


def _as_bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@lru_cache(maxsize=2)
def load_tokenizer(path: str) -> WordIds:
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(path))


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, window: int, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: the document's full windows, then its remainder.
    ``with_ids`` adds the piece's token ids as little-endian bytes."""
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * window
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sub", *(["ids"] if with_ids else [])]
    types = [*[pa.int64()] * 5, pa.int32(), *([pa.binary()] if with_ids else [])]

    def run(batches):
        ids_of = load_tokenizer(tokenizer_path)
        sub = TaskContext.get().partitionId()  # what is numbered together is never more than a task has made
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # few texts at a time become Python strings
                part = batch.slice(at, 256)
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), ids_of.encode(part.column("text").to_pylist()), strict=True):
                    ids += end
                    for s in range(0, len(ids), step):
                        piece = ids[s : s + step]
                        row = (doc_id, s // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, sub)
                        rows.append((*row, piece) if with_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


class CapacityTree:
    """Segment tree over remaining capacities 0..window; a leaf counts the runs
    of open windows with that capacity."""

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.count = [0] * (2 * self.base)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.base
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, size: int) -> int | None:
        """Smallest capacity of at least ``size`` that has an open window."""
        i = size + self.base
        if self.count[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return None


def plan(histogram: dict[int, int], window: int) -> pd.DataFrame:
    """Best-fit decreasing over a histogram ``length -> pieces``.

    One row per run: pieces ``first .. first + pieces - 1`` of ``length`` go to
    windows from ``sequence`` on, ``each`` to a window, from ``offset`` on.
    Open windows of equal capacity are used in the order they became open.
    """
    tree = CapacityTree(window)
    free: dict[int, list[tuple[int, int]]] = {}  # capacity -> runs of windows (first window, windows)
    opened, rows = 0, []

    def give(capacity: int, first: int, windows: int) -> None:
        if windows and capacity:
            free.setdefault(capacity, []).append((first, windows))
            tree.add(capacity, 1)

    for length in sorted(histogram, reverse=True):
        done, total = 0, histogram[length]
        while done < total:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity = window
                each = window // length
                first, windows = opened, -(-(total - done) // each)
                opened += windows
            else:
                first, windows = free[capacity].pop(0)
                tree.add(capacity, -1)
                each = capacity // length
            pieces = min(total - done, windows * each)
            full, part = divmod(pieces, each)
            rows.append((length, done, pieces, first, each, window - capacity))
            give(capacity - each * length, first, full)
            if part:
                give(capacity - part * length, first + full, 1)
            used = full + (part > 0)
            if used < windows:
                rest = (first + used, windows - used)
                free.setdefault(capacity, []).insert(0, rest)
                tree.add(capacity, 1)
            done += pieces
    columns = ["length", "first", "pieces", "sequence", "each", "offset"]
    return pd.DataFrame(rows, columns=columns).astype("int64")


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` per piece."""
    spark = docs.sparkSession
    pieces = stage(tokenised_pieces(docs, tokenizer_path, window, end_id, with_ids), "pieces")
    # At most ``window`` rows, whatever the corpus.
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan(histogram, window)
    table = spark.sparkContext.broadcast({c: runs[c].to_numpy() for c in runs.columns})
    numbered = gapless(pieces, ["length"], "sub", ["doc_id", "start", "ids_crc32"], "number")

    def place(batches):
        runs = table.value
        # Runs of one length are consecutive and cover its numbers without gaps;
        # lengths fall from run to run.
        starts = {int(s): (i, i + n) for s, i, n in zip(*np.unique(-runs["length"], return_index=True, return_counts=True), strict=True)}
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            run = np.empty(len(length), dtype=np.int64)
            for s in np.unique(length):
                lo, hi = starts[-int(s)]
                here = length == s
                run[here] = lo + np.searchsorted(runs["first"][lo:hi], number[here], side="right") - 1
            within = number - runs["first"][run]
            each = runs["each"][run]
            sequence = runs["sequence"][run] + within // each
            offset = runs["offset"][run] + (within % each) * length
            kept = [batch.column(c) for c in out_names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], out_names)

    out_names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else []), "sequence_id", "offset"]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, " + "ids binary, " * with_ids
    return numbered.drop("sub").mapInArrow(place, schema + "sequence_id long, offset long")


def packed_sequences(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = END_ID) -> DataFrame:
    """The windows themselves: ``(sequence_id, n_tokens, ids)``, ids as
    little-endian 32-bit numbers, without padding.  A window holds at most
    ``window`` ids, so its group is bounded."""
    pieces = pack(docs, tokenizer_path, window, end_id, with_ids=True)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
