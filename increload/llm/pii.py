"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans of four kinds: strict base
patterns and loose variants of them.  Boosted regression trees on the spans'
format and context tell how likely a candidate is real: a candidate counts as
real while training if a valid base span of its kind overlaps it, or if it
passes a check that does not depend on the base patterns (``_checked``), so
that forms only the loose patterns find can be learnt.  On a held-out half of the documents a threshold per kind is calibrated, the lowest
score whose candidates reach the wanted precision.  Loose candidates above it
are added; valid base spans always stay.

Features are small whole numbers, so all candidates of the corpus are first
counted per feature combination.  The trees are fitted on these counts; their
number is bounded by the product of the feature ranges, not by the corpus.
The fitted trees are then scored as column expressions.

Base spans are found leftmost and without overlap per kind.  Lookbehinds and
possessive quantifiers in the patterns only keep the search linear on long
runs; they match what the plain patterns match.

Defined results: a null text counts as empty.  Each input row gives one row.
Positions are code points, ends exclusive.  Extra columns are ignored.  A
corpus without real candidates adds no spans.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from increload.llm.common import stage, text_or_empty

KINDS = ("email", "ip", "card", "phone")

# What a base span of each kind looks like (see the module's docstring).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Loose candidates; every repetition is bounded, so each start costs a constant.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:@|[(\[{]\x20?at\x20?[)\]}])\x20?[A-Za-z0-9-]{1,63}"
    r"(?:\x20?(?:\.|[(\[{]\x20?dot\x20?[)\]}])\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,4}(?:\x20?\.\x20?[0-9]{1,4}){3}(?![0-9.]?[0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{3,6}){2,4}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?[0-9]{0,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
}
# What a text must hold for any match; cheap to test.
NEEDS = {
    "ip": r"[0-9]\x20?\.\x20?[0-9]",
    "card": r"[0-9](?:[\x20.-]?[0-9]){11}",
    "phone": r"[0-9](?:[\x20().-]{0,3}[0-9]){8}",
}
CUES = r"(?i)(?:e-?mail|mail|contact|call|phone|tel|fax|mobile|card|visa|pay|ip|address|host|server|from|to)[\x20:.#]{0,3}$"
CONTEXT = 16
BLOCK = 256


def _matches(text: Column, pattern: str, needs: Column) -> Column:
    return F.when(needs, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(F.array().cast("array<string>"))


def _placed(found: Column, gaps: Column) -> Column:
    """``array<struct<s, e, m>>``: code-point positions of the matches, from
    the lengths of the gaps and matches before them.  Appending to an array
    copies it, so matches are placed in blocks of ``BLOCK``, each from the
    summed lengths of the blocks before."""
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    def within(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.struct(start.alias("at"), none.alias("out")), add, lambda acc: acc["out"])

    def sums(lengths: Column) -> Column:
        """Running sums, the first 0; of one number per block."""
        return F.aggregate(lengths, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    zipped = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    last = F.floor((F.size(found) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(zipped, i * BLOCK + 1, BLOCK))
    lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x["g"]) + F.length(x["m"])))
    whole = F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), F.slice(sums(lengths), F.lit(1), last + 1).alias("at")), lambda z: within(z["b"], z["at"])))
    few = within(zipped, F.lit(0))
    return F.when(F.size(found) == 0, none).when(F.size(found) <= BLOCK, few).otherwise(whole)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Does the digit string pass the Luhn check?  From the right, every second digit is doubled."""
    def term(ch: Column, i: Column) -> Column:
        v = ch.cast("int")
        twice = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return F.when(i % 2 == 1, twice).otherwise(v)

    terms = F.transform(F.split(F.reverse(d), ""), term)
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda p: ~p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _checked(kind: str, m: Column) -> Column:
    """Is a loose match real by itself?  An address once ``at`` and ``dot`` are
    undone, octets in range, Luhn over digits with any separator, or a phone
    number of valid length that is written as one."""
    if kind == "email":
        at = F.regexp_replace(m, r"(?i)[(\[{]\x20?at\x20?[)\]}]", "@")
        plain = F.regexp_replace(F.regexp_replace(at, r"(?i)[(\[{]\x20?dot\x20?[)\]}]", "."), r"\x20", "")
        return plain.rlike(r"^[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}$")
    if kind == "ip":
        alike = m.rlike(r"^[0-9]+(\x20?\.\x20?)[0-9]+\1[0-9]+\1[0-9]+$")
        return alike & _valid("ip", F.regexp_replace(m, r"\x20", ""))
    if kind == "phone":
        return _valid("phone", m) & m.rlike(r"^(?:\+|00)|[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$")
    return _valid(kind, m)


def _valid_span(kind: str):
    return lambda x: _valid(kind, x["m"])


def _of_kind(i: int):
    return lambda x: F.struct(F.lit(i).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))


def _needed(kind: str, text: Column, loose: bool) -> Column:
    if kind == "email":
        return F.contains(text, F.lit("@")) | (text.rlike(r"[(\[{]\x20?at\x20?[)\]}]") if loose else F.lit(False))
    if kind == "phone" and not loose:
        return F.contains(text, F.lit("+"))
    return text.rlike(NEEDS[kind])


def _with_spans(df: DataFrame, patterns: dict[str, str], loose: bool, prefix: str) -> DataFrame:
    """Adds ``<prefix>_<kind>``: placed matches of each kind."""
    text = F.col("text")
    found = {k: _matches(text, p, _needed(k, text, loose)) for k, p in patterns.items()}
    df = df.withColumns({f"f_{k}": c for k, c in found.items()})
    gaps = {
        f"g_{k}": F.when(F.size(f"f_{k}") > 0, F.split(text, p, -1)).otherwise(F.array().cast("array<string>"))
        for k, p in patterns.items()
    }
    df = df.withColumns(gaps)
    df = df.withColumns({f"{prefix}_{k}": _placed(F.col(f"f_{k}"), F.col(f"g_{k}")) for k in patterns})
    return df.drop(*[f"{p}_{k}" for p in "fg" for k in patterns])


def with_base_spans(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    """``text``, the ``carry`` columns and ``base_<kind>``: the valid base spans."""
    df = _with_spans(docs.select(*carry, text_or_empty().alias("text")), BASE, False, "base")
    return df.withColumns({f"base_{k}": F.filter(f"base_{k}", _valid_span(k)) for k in KINDS})


FEATURES = ("kind", "n_digits", "n_chars", "groups", "plus", "paren", "spaced", "dots", "before", "after", "cue", "upper")


def _features(kind: int, text: Column, x: Column) -> Column:
    """Format and context of a candidate, as small whole numbers."""
    m = x["m"]
    head = F.substring(text, F.greatest(x["s"] + 1 - CONTEXT, F.lit(1)), F.least(x["s"], F.lit(CONTEXT)))
    tail = F.substring(text, x["e"] + 1, F.lit(1))

    def side(c: Column) -> Column:
        return F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike("^[0-9]$"), 2).when(c.rlike(r"^\p{L}$"), 3).otherwise(4)

    groups = F.size(F.split(m, r"[^0-9A-Za-z]+"))
    return F.struct(
        F.lit(kind).alias("kind"),
        F.least(F.length(digits(m)), F.lit(20)).alias("n_digits"),
        F.least(F.floor(F.length(m) / F.lit(6)), F.lit(6)).cast("int").alias("n_chars"),
        F.least(groups, F.lit(7)).alias("groups"),
        F.contains(m, F.lit("+")).cast("int").alias("plus"),
        F.contains(m, F.lit("(")).cast("int").alias("paren"),
        F.contains(m, F.lit(" ")).cast("int").alias("spaced"),
        F.least(F.length(F.regexp_replace(m, r"[^.]", "")), F.lit(4)).alias("dots"),
        side(F.right(head, F.lit(1))).alias("before"),
        side(tail).alias("after"),
        head.rlike(CUES).cast("int").alias("cue"),
        m.rlike("[A-Z]").cast("int").alias("upper"),
    )


def with_candidates(df: DataFrame) -> DataFrame:
    """Adds ``cands``: loose candidates as ``struct<kind, s, e, real, free, f>``.

    ``real``: overlaps a valid base span of its kind or passes the check.  ``free``: overlaps no
    valid base span of any kind.
    """
    df = _with_spans(df, LOOSE, True, "loose")
    text = F.col("text")

    def overlaps(spans: Column, x: Column) -> Column:
        return F.exists(spans, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))

    def candidates(i: int, kind: str) -> Column:
        def make(x: Column) -> Column:
            hits = {k: overlaps(F.col(f"base_{k}"), x) for k in KINDS}
            free = ~reduce(lambda a, b: a | b, hits.values())
            return F.struct(
                F.lit(i).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), (hits[kind] | _checked(kind, x["m"])).alias("real"), free.alias("free"), _features(i, text, x).alias("f")
            )

        return F.transform(f"loose_{kind}", make)

    cands = F.concat(*[candidates(i, k) for i, k in enumerate(KINDS)])
    return df.withColumn("cands", cands).drop(*[f"loose_{k}" for k in KINDS])


@dataclass(frozen=True)
class Tree:
    """``feature <= cut`` goes left; leaves are numbers."""

    feature: str
    cut: int
    left: Tree | float
    right: Tree | float

    def value(self, row: dict) -> float:
        side = self.left if row[self.feature] <= self.cut else self.right
        return side.value(row) if isinstance(side, Tree) else side

    def column(self, f: Column) -> Column:
        sides = [s.column(f) if isinstance(s, Tree) else F.lit(float(s)) for s in (self.left, self.right)]
        return F.when(f[self.feature] <= self.cut, sides[0]).otherwise(sides[1])


def _leaf(rows: list, shrink: float) -> float:
    g = sum(r["g"] for r in rows)
    h = sum(r["h"] for r in rows)
    return shrink * g / (h + 1.0)


def _grow(rows: list, depth: int, shrink: float) -> Tree | float:
    """A regression tree on gradient sums ``g`` and curvatures ``h``."""
    g, h = sum(r["g"] for r in rows), sum(r["h"] for r in rows)
    best = (1e-6, None, None)
    for name in FEATURES if depth else ():
        sums: dict[int, list[float]] = {}
        for r in rows:
            s = sums.setdefault(r[name], [0.0, 0.0])
            s[0] += r["g"]
            s[1] += r["h"]
        gl = hl = 0.0
        for cut in sorted(sums)[:-1]:
            gl += sums[cut][0]
            hl += sums[cut][1]
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best[0]:
                best = (gain, name, cut)
    if best[1] is None:
        return _leaf(rows, shrink)
    _, name, cut = best
    sides = [[r for r in rows if (r[name] <= cut) is left] for left in (True, False)]
    return Tree(name, cut, *[_grow(s, depth - 1, shrink) for s in sides])


@dataclass(frozen=True)
class Model:
    """Boosted trees and, per kind, the score from which a candidate is added."""

    start: float
    trees: tuple
    thresholds: dict

    def score(self, f: Column) -> Column:
        terms = [t.column(f) if isinstance(t, Tree) else F.lit(float(t)) for t in self.trees]
        return reduce(lambda a, b: a + b, terms, F.lit(self.start))

    def accepts(self, c: Column) -> Column:
        cut = reduce(lambda acc, kv: F.when(c["kind"] == kv[0], F.lit(kv[1])).otherwise(acc), self.thresholds.items(), F.lit(float("inf")))
        return self.score(c["f"]) >= cut


def fit(counts: list[dict], rounds: int = 30, depth: int = 3, shrink: float = 0.3, precision: float = 0.95, support: int = 20) -> Model | None:
    """Boosted trees on counted feature rows (``fold`` 0 trains, 1 calibrates).

    A kind whose held-out candidates never reach ``precision`` with at least
    ``support`` of them gets no threshold: none of its candidates are added.
    """
    train = [r for r in counts if r["fold"] == 0]
    n, pos = sum(r["n"] for r in train), sum(r["pos"] for r in train)
    if not pos:
        return None
    start = math.log(pos / max(n - pos, 0.5))
    scores, trees = [start] * len(train), []
    for _ in range(rounds):
        for r, s in zip(train, scores, strict=True):
            p = 1 / (1 + math.exp(-s))
            r["g"], r["h"] = r["pos"] - r["n"] * p, r["n"] * p * (1 - p)
        tree = _grow(train, depth, shrink)
        trees.append(tree)
        scores = [s + (tree.value(r) if isinstance(tree, Tree) else tree) for r, s in zip(train, scores, strict=True)]
    thresholds = {}
    for kind in range(len(KINDS)):
        held = [r for r in counts if r["fold"] == 1 and r["kind"] == kind]
        ranked = sorted(((start + sum(t.value(r) if isinstance(t, Tree) else t for t in trees), r["n"], r["pos"]) for r in held), reverse=True)
        seen = real = 0
        for i, (score, n_row, pos_row) in enumerate(ranked):
            seen, real = seen + n_row, real + pos_row
            ends = i + 1 == len(ranked) or ranked[i + 1][0] < score
            if ends and seen >= support and real >= precision * seen and score > 0:
                thresholds[kind] = score - 1e-6  # sums of leaves differ in their last bits by order
    return Model(start, tuple(trees), thresholds)


def _count(cands: DataFrame) -> list[dict]:
    """Candidates per fold and feature combination; a bounded number of rows."""
    c = cands.select((F.pmod(F.xxhash64("key", F.lit("fold")), F.lit(2))).cast("int").alias("fold"), F.explode("cands").alias("c"))
    real = F.count_if(F.col("c.real")).alias("pos")
    rows = c.groupBy("fold", *[F.col(f"c.f.{f}").alias(f) for f in FEATURES]).agg(F.count(F.lit(1)).alias("n"), real).collect()
    return sorted((r.asDict() for r in rows), key=lambda r: (r["fold"], *[r[f] for f in FEATURES]))


def find_personal_data(docs: DataFrame, carry: Sequence[str] = ("doc_id",), precision: float = 0.95) -> DataFrame:
    """The ``carry`` columns, ``base`` and ``spans``: arrays of
    ``struct<kind, s, e>`` in the order of kinds, then starts."""
    spans = with_candidates(with_base_spans(docs, carry))
    base = F.concat(*[F.transform(f"base_{k}", _of_kind(i)) for i, k in enumerate(KINDS)])
    free = F.filter("cands", lambda c: c["free"])
    found = spans.select(*carry, base.alias("base"), F.xxhash64("text").alias("key"), "cands")
    found = stage(found, "candidates")
    model = fit(_count(found), precision=precision)
    if model is None or not model.thresholds:
        return found.select(*carry, "base", F.col("base").alias("spans"))
    added = F.transform(F.filter(free, model.accepts), lambda c: F.struct(c["kind"], c["s"], c["e"]))
    apart = _without_overlap(F.array_sort(added))
    return found.select(*carry, "base", F.array_sort(F.concat("base", apart)).alias("spans"))


def _without_overlap(spans: Column) -> Column:
    """Of overlapping added spans the first by kind and start stays."""
    none = F.expr("cast(array() as array<struct<kind:int,s:int,e:int>>)")

    def add(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(spans, none, add)


def count_kind(spans: str, kind: str) -> Column:
    i = KINDS.index(kind)
    return F.size(F.filter(spans, lambda x: x["kind"] == i)).cast("long")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, precision: float = 0.95) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in brackets."""
    marked = docs.withColumns({f"__llm_in_{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)})
    carry = ["text", *[f"__llm_in_{i}" for i in range(len(docs.columns))]]
    found = find_personal_data(marked.select(*carry), [c for c in carry if c != "text"], precision)
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    text_at = docs.columns.index("text")
    text = F.col(f"__llm_in_{text_at}")

    def cut(acc: Column, x: Column) -> Column:
        piece = F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        out = F.when(x["e"] <= acc["at"], acc["out"]).otherwise(F.concat(acc["out"], piece, names[x["kind"]]))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    by_start = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(by_start, start, cut, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    clean = F.when(F.size("spans") > 0, clean).otherwise(text)
    return found.select(*[clean.alias(c) if i == text_at else F.col(f"__llm_in_{i}").alias(c) for i, c in enumerate(docs.columns)])
