"""Fill-in-the-middle documents, cut by bytes and counted in code points.

A task looks at a batch of texts as one array of UTF-8 bytes.  Its exception
index records the multibyte characters alone: where each starts and how many
bytes beyond one all up to it have taken.  A cut between bytes becomes a
number of code points, and the other way round, by one binary search in that
index (``searchsorted``); stretches of ASCII between exceptions are plain
arithmetic, and a pure ASCII text has no entry at all.

Units of a text are its words with the white space before them, white space
left at the end being one unit more (``unit="token"``), or its code points
(``unit="char"``).  The prefix ends after the smaller and the middle after the
larger of two hashed numbers of units.  Memory is bounded by ``SLICE_BYTES``
or one text, whichever is larger.

Defined results: a null text counts as empty; an empty text, and one that
holds a marker, stays plain.  A missing id hashes as an empty one.  Repeated
rows give repeated rows.  Extra columns are ignored; an empty table gives an
empty result.  Bytes that are not UTF-8 are carried through unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SLICE_BYTES = 4 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class ExceptionIndex:
    """Multibyte characters of a byte array: byte position, code-point
    position, and excess bytes of all characters before each."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.before = np.concatenate([[0], np.cumsum(excess)])
        self.char_at = self.at - self.before[:-1]

    def chars(self, cut: np.ndarray) -> np.ndarray:
        """Code points before each byte cut (a cut lies between characters)."""
        return cut - self.before[np.searchsorted(self.at, cut, side="left")]

    def bytes(self, cut: np.ndarray) -> np.ndarray:
        """Bytes before each code-point cut."""
        return cut + self.before[np.searchsorted(self.char_at, cut, side="left")]


def unit_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte positions where words end, the number of the first such end of each
    text (texts lie at ``starts..ends`` in ``data``), and units of each text."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    final = np.ones(len(data), dtype=bool)
    final[:-1] = space[1:]
    final[ends[ends > starts] - 1] = True
    word_ends = np.flatnonzero(final & ~space) + 1
    first = np.searchsorted(word_ends, starts, side="right")
    words = np.searchsorted(word_ends, ends, side="right") - first
    filled = ends > starts
    tail = np.zeros(len(starts), dtype=bool)
    tail[filled] = space[ends[filled] - 1]
    return word_ends, first, words + tail


def _numbers(doc_id, seed: str) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))


def transform_texts(ids: list, data: np.ndarray, offsets: np.ndarray, seed: str, rate: int, spm_rate: int, unit: str) -> list[tuple]:
    """Rows of ``SCHEMA`` (outputs as bytes) for texts at ``offsets`` of ``data``."""
    starts, ends = offsets[:-1], offsets[1:]
    h = np.array([_numbers(i, seed) for i in ids], dtype=np.int64).reshape(-1, 4)
    index = ExceptionIndex(data)
    if unit == "token":
        word_ends, first, n = unit_ends(data, starts, ends)
    else:
        n = index.chars(ends) - index.chars(starts)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    if unit == "token":
        inner = word_ends[np.clip(first[:, None] + cuts - 1, 0, max(len(word_ends) - 1, 0))] if len(word_ends) else np.zeros_like(cuts)
        at = np.where(cuts == 0, starts[:, None], np.where(cuts == n[:, None], ends[:, None], inner))
    else:
        at = index.bytes(index.chars(starts)[:, None] + cuts)
    chars = index.chars(np.column_stack([starts, at]))
    raw = data.tobytes()
    rows = []
    for i, doc_id in enumerate(ids):
        s, a, b, e = int(starts[i]), int(at[i, 0]), int(at[i, 1]), int(ends[i])
        text = raw[s:e]
        if not text or h[i, 2] % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
            rows.append((doc_id, int(n[i]), "plain", None, None, text))
            continue
        prefix, middle, suffix = raw[s:a], raw[a:b], raw[b:e]
        if h[i, 3] % 100 < spm_rate:
            form, output = "spm", SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
        else:
            form, output = "psm", PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
        rows.append((doc_id, int(n[i]), form, int(chars[i, 1] - chars[i, 0]), int(chars[i, 2] - chars[i, 1]), output))
    return rows


def fill_in_middle(docs: DataFrame, seed: str = "42", rate: int = 50, spm_rate: int = 80, unit: str = "token") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` per document:
    ``n`` units, of which ``rate`` percent of the documents are rearranged, and
    ``spm_rate`` percent of these with the suffix first."""
    if unit not in ("token", "char"):
        raise ValueError("unit is 'token' or 'char'")
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            text = batch.column("text")
            kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
            offsets = np.frombuffer(text.buffers()[1], dtype=kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
            at = 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
                here = offsets[at : to + 1]
                rows = transform_texts(ids[at:to], data[here[0] : here[-1]], here - here[0], seed, rate, spm_rate, unit)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)]
                columns[-1] = columns[-1].view(pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)
                at = to

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of.  Texts in ``psm`` or ``spm`` form
    hold no marker, so the first one of each kind is the one put in."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    head = F.split(body, F.when(form == "psm", F.lit(s)).otherwise(F.lit(p)), 2)
    tail = F.split(head[1], m, 2)
    return F.when(form == "plain", output).when(form == "psm", F.concat(head[0], tail[1], tail[0])).otherwise(F.concat(tail[0], tail[1], head[0]))
