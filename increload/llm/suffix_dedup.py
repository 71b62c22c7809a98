"""Removal of repeated byte strings with suffix arrays over content shards.

A byte goes if a string of ``length`` bytes that covers it also starts
anywhere else in the corpus.  Comparing all shards of a corpus with each other
would grow with the square of its size, so shards are formed by content:

1. Equal texts are met once.  Each start of a ``length``-byte string (a
   *window*) chooses an anchor within it by winnowing: the smallest hash of a
   ``GRAM``-byte string, leftmost first.  Equal windows choose equal anchors, so
   a window whose anchor occurs nowhere else is unique.  The bytes of successive
   windows with one anchor make a *piece*; there is about one for 110 bytes of
   text, and only those whose anchor occurs twice go on.
2. Pieces equal in all bytes are folded map-side, however many documents hold
   them; their windows repeat.
3. The different pieces of one anchor meet in one task, which cuts its stream
   into shards of at most ``shard_bytes``: a suffix array each by
   Larsson-Sadakane refinement (ranks of doubled length, only groups not yet in
   order are sorted again), common prefixes by Kasai's rule, run over all pieces
   of the shard in lockstep, and groups of windows whose common prefix reaches
   ``length``.  Shards that share an anchor are merged by binary search of the
   later one's windows in the earlier one's suffix array.
4. An anchor with more than ``hot_kinds`` different pieces (a phrase in a large
   share of all documents) would fill one task.  Its pieces take the same way
   again with longer ``GRAM`` strings, which part pieces that share the phrase
   alone and fold those that share more.  Where hardly any longer string is
   left, the few windows are spread by their digests and counted.

Windows found go back to the documents through the pieces' digests.  Hashes
only choose who meets whom; equality is decided by bytes, or by digests of 128
bits and more where equal bytes are folded.  A task holds a batch, a segment of
text and a shard; a document's own list of pieces is bounded by its length.

Defined results: a null text counts as empty; texts shorter than ``length``
keep everything.  Repeated rows are occurrences of their own, so two equal rows
lose all their windows.  Rows without an id are like others.  Extra columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from increload.llm.common import stage

GRAM = 128
SEGMENT = 1 << 18
SHARD_BYTES = 1 << 19
HOT_KINDS = 256
KNOWN = 100_000  # digests a task remembers, so as to send equal pieces' bytes once

POSITION_BITS = np.uint64((1 << 22) - 1)
BASE = 0x9E3779B97F4A7C15
SPANS = "array<struct<start: long, end: long>>"


class Winnower:
    """Anchors of all windows of concatenated texts of up to ``2 * SEGMENT`` bytes."""

    def __init__(self, length: int, gram: int, seed: int = 7):
        self.length, self.gram, self.span = length, gram, length - gram + 1
        rng = np.random.default_rng(seed)
        self.letters = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = np.cumprod(np.full(2 * SEGMENT, BASE, dtype=np.uint64))
        self.inverse = np.cumprod(np.full(2 * SEGMENT, pow(BASE, -1, 1 << 64), dtype=np.uint64))

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """A hash of each ``gram``-byte string, from running sums modulo 2^64."""
        n = len(data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.letters[data] * self.powers[:n], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.inverse[: n - self.gram + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def runs(self, data: np.ndarray, offsets: np.ndarray):
        """``(key, anchor, first window, last window)`` of each run of windows with
        one anchor, as positions in ``data``; texts lie between ``offsets``."""
        if len(data) < self.length:
            return tuple(np.empty(0, dtype=d) for d in (np.uint64, np.int64, np.int64, np.int64))
        h = self.hashes(data)
        least = (h & ~POSITION_BITS) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while 2 * reach <= self.span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < self.span:
            rest = self.span - reach
            least = np.minimum(least[:-rest], least[rest:])
        inside = np.zeros(len(least) + 1, dtype=np.int64)  # windows that cross no text's end
        long_enough = np.diff(offsets) >= self.length
        np.add.at(inside, offsets[:-1][long_enough], 1)
        np.add.at(inside, offsets[1:][long_enough] - self.length + 1, -1)
        window = np.flatnonzero(np.cumsum(inside[:-1]))
        anchor = (least[window] & POSITION_BITS).astype(np.int64)
        turn = np.flatnonzero(np.diff(anchor)) + 1
        first = np.concatenate([[0], turn]) if len(window) else turn
        last = np.concatenate([turn, [len(window)]]) - 1 if len(window) else turn
        return h[anchor[first]], anchor[first], window[first], window[last]


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the rank of each (Larsson and Sadakane)."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words = np.ndarray((n,), dtype=">u8", buffer=padded.data, strides=(1,)).astype(np.uint64)
    known = np.minimum(n - np.arange(n), 7).astype(np.uint64)
    words = (words >> np.uint64(8) << np.uint64(8)) | known  # seven bytes, shorter suffixes first
    order = np.argsort(words)
    words = words[order]
    rank = np.empty(n, dtype=np.int64)
    places, h = np.arange(n), 7
    changes = np.concatenate([[True], words[1:] != words[:-1]]) if n else np.zeros(0, dtype=bool)
    suffixes = order
    while len(places):
        rank[suffixes] = np.maximum.accumulate(np.where(changes, places, 0))
        single = changes & np.concatenate([changes[1:], [True]])
        places = places[~single]  # of groups not yet in order
        suffixes = order[places]
        if not len(places):
            break
        after = suffixes + h
        following = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        both = rank[suffixes] * (n + 1) + following
        by = np.argsort(both)
        both, suffixes = both[by], suffixes[by]
        order[places] = suffixes
        changes = np.concatenate([[True], both[1:] != both[:-1]])
        h *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cap: int) -> np.ndarray:
    """Bytes each suffix shares with its predecessor in ``order``, up to ``cap``
    (Kasai: one less than its neighbour to the left at least).  Pieces at
    ``starts`` are independent chains and advance in lockstep."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(cap + 16, dtype=np.uint8)])
    words = np.ndarray((n + cap + 8,), dtype="<u8", buffer=padded.data, strides=(1,)).astype(np.uint64)
    by_length = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[by_length], lengths[by_length]
    shared = np.zeros(n, dtype=np.int32)
    carry = np.zeros(len(starts), dtype=np.int64)
    for t in range(int(lengths[0]) if len(lengths) else 0):
        here = starts[: int(np.searchsorted(-lengths, -t, side="left"))] + t
        at = rank[here]
        before = order[np.maximum(at - 1, 0)]
        h = np.maximum(carry[: len(here)] - 1, 0)
        h[at == 0] = 0
        room = np.minimum(n - np.maximum(here, before), cap)
        open_ = np.flatnonzero((at > 0) & (h < room))
        while len(open_):
            k = h[open_]
            differ = words[here[open_] + k] ^ words[before[open_] + k]
            same = differ == 0
            lowest = np.frexp((differ & (~differ + np.uint64(1))).astype(np.float64))[1]
            h[open_] = k + np.where(same, 8, (lowest - 1) >> 3)
            open_ = open_[same & (h[open_] < room[open_])]
        h = np.minimum(h, room)
        shared[here] = h
        carry[: len(here)] = h
    return shared


class Shard:
    """Pieces, their suffix array, and which windows are known to repeat."""

    def __init__(self, pieces: list[bytes], length: int):
        self.length = length
        self.data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.order, rank = suffix_array(self.data)
        shared = common_prefixes(self.data, self.order, rank, self.starts, self.lengths, length)
        window = np.zeros(len(self.data), dtype=bool)
        for s, n in zip(self.starts.tolist(), self.lengths.tolist()):
            window[s : s + n - length + 1] = True
        in_order = window[self.order]
        group = np.cumsum(shared[self.order] < length)
        often = np.bincount(group[in_order], minlength=int(group[-1]) + 1 if len(group) else 1) >= 2
        self.repeats = np.zeros(len(self.data), dtype=bool)
        self.repeats[self.order] = in_order & often[group]
        self.windows_before = np.concatenate([[0], np.cumsum(in_order)])
        padded = np.concatenate([self.data, np.zeros(length + 8, dtype=np.uint8)])
        self.words = np.ndarray((len(self.data) + length,), dtype=">u8", buffer=padded.data, strides=(1,))

    def windows(self, first: int, last: int) -> np.ndarray:
        """Starts of the windows of pieces ``first .. last - 1``."""
        spans = zip(self.starts[first:last].tolist(), self.lengths[first:last].tolist())
        return np.concatenate([np.arange(s, s + n - self.length + 1) for s, n in spans])

    def _below(self, other: Shard, asked: np.ndarray, or_equal: bool) -> np.ndarray:
        """By binary search: how many suffixes precede (or equal, over ``length`` bytes) each asked window of ``other``."""
        low, high = np.zeros(len(asked), dtype=np.int64), np.full(len(asked), len(self.order), dtype=np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) >> 1
            own, theirs = self.order[middle], asked[open_]
            sign = np.zeros(len(open_), dtype=np.int64)  # of own minus theirs
            left = np.arange(len(open_))
            for k in range(0, self.length, 8):
                a, b = self.words[own[left] + k].astype(np.uint64), other.words[theirs[left] + k].astype(np.uint64)
                if k + 8 > self.length:
                    cut = np.uint64(8 * (k + 8 - self.length))
                    a, b = a >> cut, b >> cut
                sign[left] = np.where(a < b, -1, np.where(a > b, 1, 0))
                left = left[a == b]
                if not len(left):
                    break
            sign[(sign == 0) & (own + self.length > len(self.data))] = -1  # a suffix that ends before
            up = (sign < 0) | ((sign == 0) & or_equal)
            low[open_[up]] = middle[up] + 1
            high[open_[~up]] = middle[~up]
        return low

    def merge(self, other: Shard, asked: np.ndarray) -> None:
        """Marks the asked windows of ``other`` that are windows here too, in both."""
        low, high = self._below(other, asked, False), self._below(other, asked, True)
        met = self.windows_before[high] > self.windows_before[low]
        other.repeats[asked[met]] = True
        for a, b in set(zip(low[met].tolist(), high[met].tolist())):
            here = self.order[a:b]
            self.repeats[here[self.windows_before[a + 1 : b + 1] > self.windows_before[a:b]]] = True

    def ranges(self) -> list[list[tuple[int, int]]]:
        """Of each piece, ``start, end`` of its runs of repeating windows."""
        out = []
        for s, n in zip(self.starts.tolist(), self.lengths.tolist()):
            edge = np.diff(self.repeats[s : s + n].astype(np.int8), prepend=0, append=0)
            out.append(list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())))
        return out


def compare_pieces(rows, length: int, shard_bytes: int):
    """``(key, digest, ranges)`` of pieces ``(key, digest, bytes)`` that come in
    order of their keys, shard by shard; shards with a common key are merged."""
    held: list[tuple[list, Shard]] = []  # shards whose last key may go on

    def close(part: list):
        shard = Shard([r[2] for r in part], length)
        key = part[0][0]
        same = next((i for i, r in enumerate(part) if r[0] != key), len(part))
        for earlier, before in held:
            if earlier[-1][0] == key:
                before.merge(shard, shard.windows(0, same))
        if same < len(part):
            yield from emit()
        held.append((part, shard))

    def emit():
        for part, shard in held:
            yield from ((key, digest, r) for (key, digest, _), r in zip(part, shard.ranges(), strict=True) if r)
        held.clear()

    part, size = [], 0
    for row in rows:
        if part and size + len(row[2]) > shard_bytes:
            yield from close(part)
            part, size = [], 0
        part.append(row)
        size += len(row[2])
    if part:
        yield from close(part)
    yield from emit()


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8), offsets


def _segments(offsets: np.ndarray, overlap: int):
    """Cuts texts at ``offsets`` into stretches of about ``SEGMENT`` bytes:
    whole texts together, a longer one in parts of ``SEGMENT`` window starts."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SEGMENT, side="right")) - 1)
        start, end = int(offsets[at]), int(offsets[to])
        if to > at + 1 or end - start <= SEGMENT:
            yield at, start, offsets[at : to + 1]
        else:
            for s in range(start, end - overlap, SEGMENT):
                yield at, s, np.array([s, min(s + SEGMENT + overlap, end)])
        at = to


def anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``(rid, key, lo, hi)``: windows ``lo[i]..hi[i]`` of a text have an anchor
    with the hash ``key``.  A text that repeats itself is one row per key."""

    def run(batches):
        find = Winnower(length, gram)
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            data, offsets = _binary(batch.column("text"))
            for first, start, cuts in _segments(offsets, length - 1):
                key, _, lo, hi = find.runs(data[start : cuts[-1]], cuts - start)
                row = first + np.searchsorted(cuts - start, lo, side="right") - 1
                order = np.lexsort((key, row))
                key, row, lo, hi = key[order], row[order], lo[order], hi[order]
                new = np.ones(len(key), dtype=bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                at = np.flatnonzero(new)
                base = offsets[row] - start
                ends = pa.array(np.append(at, len(key)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array((x - base).astype(np.int32))) for x in (lo, hi)]
                yield pa.RecordBatch.from_arrays([pa.array(rid[row[at]]), pa.array(key[at].view(np.int64)), *lists], ["rid", "key", "lo", "hi"])

    return texts.select("rid", "text").mapInArrow(run, "rid long, key long, lo array<int>, hi array<int>")


def pieces(texts: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """``(rid, key, digest, lo, windows, bytes)`` of the chosen anchors, one row
    for the equal pieces of a text.  A task sends the bytes of pieces it knows
    already only after ``KNOWN`` others."""
    names = ["rid", "key", "digest", "lo", "windows", "bytes"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.binary()]
    lists = chosen.groupBy("rid").agg(F.collect_list(F.struct("key", "lo", "hi")).alias("runs"))

    def run(batches):
        known: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                rows = []
                for rid, text, runs in zip(*(part.column(c).to_pylist() for c in ("rid", "text", "runs")), strict=True):
                    met: dict[tuple[int, bytes], list] = {}
                    for r in runs:
                        for lo, hi in zip(r["lo"], r["hi"], strict=True):
                            piece = text[lo : hi + length]
                            digest = hashlib.blake2b(piece, digest_size=16).digest()
                            met.setdefault((r["key"], digest), [[], hi - lo + 1, piece])[0].append(lo)
                    for (key, digest), (los, windows, piece) in met.items():
                        new = digest not in known
                        if new:
                            if len(known) >= KNOWN:
                                known.clear()
                            known.add(digest)
                        rows.append((rid, key, digest, los, windows, piece if new else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)

    schema = "rid long, key long, digest binary, lo array<int>, windows int, bytes binary"
    return texts.select("rid", "text").join(lists, "rid").mapInArrow(run, schema)


def repeating_windows(texts: DataFrame, length: int, gram: int, shard_bytes: int, hot_kinds: int) -> DataFrame:
    """``(rid, ranges)``: runs of windows of each text that start anywhere else
    too.  ``texts`` ``(rid, text)`` is a written table of different texts."""
    runs = stage(anchors(texts, length, gram), "anchors")
    # Written tables on both sides of a join, so that Spark can split a hot key.
    twice = runs.groupBy("key").agg(F.sum(F.size("lo")).alias("n")).where("n > 1").select("key")
    found = stage(pieces(texts, runs.join(stage(twice, "keys"), "key"), length), "pieces")
    kinds = found.groupBy("key", "digest").agg(
        F.sum(F.size("lo")).alias("n"), F.first("bytes", ignorenulls=True).alias("bytes"), F.first("windows").alias("windows")
    )
    kinds = stage(kinds, "kinds")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("windows").cast("long").alias("end")))
    folded = kinds.where("n > 1").select("key", "digest", whole.alias("ranges"))
    unfolded = kinds.where("n = 1").select("key", "digest")
    partly = compared_kinds(kinds, length, gram, shard_bytes, hot_kinds).join(unfolded, ["key", "digest"], "left_semi")
    repeating = stage(folded.unionByName(partly), "repeating")

    def shifted(lo):
        return F.transform("ranges", lambda r: F.struct((r["start"] + lo).alias("start"), (r["end"] + lo).alias("end")))

    marks = found.select("rid", "key", "digest", "lo").join(repeating, ["key", "digest"])
    marks = marks.select("rid", F.flatten(F.transform("lo", shifted)).alias("ranges"))
    return marks.groupBy("rid").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def compared_kinds(kinds: DataFrame, length: int, gram: int, shard_bytes: int, hot_kinds: int) -> DataFrame:
    """``(key, digest, ranges)``: windows of a piece that are windows of another
    piece with its key.  ``kinds`` holds different pieces, and is written."""
    per_key = stage(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "kinds_of_keys")
    together = kinds.select("key", "digest", "bytes").join(per_key, "key")

    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("key", "digest", "bytes"))))
        out = []
        for key, digest, ranges in compare_pieces(rows, length, shard_bytes):
            out.append((key, digest, [{"start": s, "end": e} for s, e in ranges]))
            if len(out) >= 4096:
                yield _ranges_batch(out)
                out = []
        if out:
            yield _ranges_batch(out)

    schema = f"key long, digest binary, ranges {SPANS}"
    dealt = together.where(F.col("kinds") <= hot_kinds).drop("kinds").repartition("key").sortWithinPartitions("key", "digest")
    compared = dealt.mapInArrow(run, schema)
    if per_key.where(F.col("kinds") > hot_kinds).isEmpty():
        return compared
    hot = together.where(F.col("kinds") > hot_kinds).select(F.monotonically_increasing_id().alias("rid"), "key", "digest", F.col("bytes").alias("text"))
    hot = stage(hot, "hot_pieces")
    longer = length - (length - gram) // 4
    marks = repeating_windows(hot, length, longer, shard_bytes, hot_kinds) if longer < length - 4 else _counted(hot, length)
    return compared.unionByName(hot.select("rid", "key", "digest").join(marks, "rid").select("key", "digest", "ranges"))


def _counted(texts: DataFrame, length: int) -> DataFrame:
    """:func:`repeating_windows` by digests of all windows, for texts with few."""
    at = F.explode(F.sequence(F.lit(0), F.octet_length("text") - length))
    starts = texts.select("rid", "text", at.alias("at"))
    string = F.unhex(F.sha2(F.substring("text", F.col("at") + 1, F.lit(length)), 256))
    starts = stage(starts.select("rid", "at", string.alias("string")), "windows")
    often = stage(starts.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("string"), "often")
    one = F.struct(F.col("at").cast("long").alias("start"), (F.col("at") + 1).cast("long").alias("end"))
    return starts.join(often, "string").groupBy("rid").agg(F.collect_list(one).alias("ranges"))


def _ranges_batch(rows: list) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), span))], ["key", "digest", "ranges"])


def joined_spans(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows ``start..end - 1`` cover."""
    out: list[list[int]] = []
    for start, end in sorted((r["start"], r["end"] + length - 1) for r in ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(s) for s in out]


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _removed(marked: DataFrame, length: int, with_kept: bool) -> DataFrame:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = ["tid", "n_removed", "spans", "kept_sha256", *(["kept"] if with_kept else [])]
    types = [pa.binary(), pa.int64(), span, pa.string(), *([pa.binary()] if with_kept else [])]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                rows = []
                for tid, text, ranges in zip(*(part.column(c).to_pylist() for c in ("tid", "text", "ranges")), strict=True):
                    spans = joined_spans(ranges, length)
                    kept = kept_bytes(text, spans)
                    row = (tid, sum(e - s for s, e in spans), [{"start": s, "end": e} for s, e in spans], hashlib.sha256(kept).hexdigest())
                    rows.append((*row, kept) if with_kept else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)

    schema = f"tid binary, n_removed long, spans {SPANS}, kept_sha256 string" + ", kept binary" * with_kept
    return marked.select("tid", "text", "ranges").mapInArrow(run, schema)


def remove_repeats(
    docs: DataFrame, length: int = 400, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_kinds: int = HOT_KINDS,
    with_kept: bool = False,
) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256)`` per row of
    ``docs``; ``with_kept`` adds the bytes that stay."""
    if not 8 <= gram <= length:
        raise ValueError("gram must be between 8 and length")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("tid", F.unhex(F.sha2("text", 256))).withColumn("n_bytes", F.octet_length("text").cast("long"))
    met = rows.where(F.col("n_bytes") >= length).groupBy("tid").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    texts = stage(met.withColumn("rid", F.monotonically_increasing_id()), "texts")

    marks = repeating_windows(texts, length, gram, shard_bytes, hot_kinds)
    single = texts.where("copies = 1").join(marks, "rid")
    cut = stage(_removed(single, length, with_kept), "removed")

    copied = texts.where("copies > 1").select("tid", F.octet_length("text").cast("long").alias("n"))
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    nothing = [F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), *([F.lit(b"").alias("kept")] if with_kept else [])]
    results = cut.unionByName(copied.select("tid", F.col("n").alias("n_removed"), all_of_it.alias("spans"), *nothing))
    out = rows.select("doc_id", "tid", "n_bytes", *(["text"] if with_kept else [])).join(results, "tid", "left")
    spans = F.coalesce("spans", F.array().cast(SPANS))
    return out.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"), spans.alias("spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("tid"))).alias("kept_sha256"),
        *([F.coalesce("kept", "text").alias("kept")] if with_kept else []),
    )
