"""Quality classifier by co-training of a text view and a metadata view.

Two logistic classifiers see different sides of a document: its text content
(shares of character classes, repetition, word shapes) and its page metadata
(language, source, length, line layout).  Both start from the labelled
documents.  In each round each view scores every unlabelled document and hands
the ones it is sure of, with their pseudo-labels, to the other view.  The
pseudo-labels of a class weigh together no more than its labelled documents, so
a round means the same for ten thousand documents and for ten billion.  Scores
are calibrated on labelled documents that neither view was trained on (Platt
scaling); a round that worsens a view's calibrated loss is undone.  The
calibrated views are combined by a logistic regression on the same held-out
documents and score every document whole.

Labelled documents are a bounded sample, chosen by a hash of ``doc_id``: at most
``max_labelled``, held by the driver as ``N_FEATURES`` numbers each.  Unlabelled
ones are not bounded: their features are written once to the session's shared
folder, and each Newton step of a round is one pass over them, in which every
task sums its gradients and Hessians.  What reaches the driver is a fixed number
of such sums.  Scoring reads every document once and shuffles nothing.

Defined results: a null text counts as empty; null metadata is a value of its
own.  Labels that are null or neither 0 nor 1 are ignored, several labels of
one document are averaged and rounded; of rows with one labelled id the
smallest features count.  Every other row takes part as an unlabelled document,
repeated ones repeatedly.  Without labels of both classes every document gets
probability 1 and is kept.  Each input row gives one row.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from increload.llm.common import matrix, stage

MAX_LABELLED = 20_000
ROUNDS = 4
STEPS = 6  # Newton steps of a round, from where the last one ended
SURE = 0.95
SLOTS = 32  # rows in which the sums of all tasks reach the driver
HASHED = 16
TEXTS = 256

# Byte classes whose shares describe a text.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "space": b" \t", "line": b"\n\r", "stop": b".", "comma": b",;:", "excited": b"!?", "pipe": b"|", "money": b"$",
    "hash": b"#", "amp": b"&", "percent": b"%", "star": b"*", "quote": b"\"'`", "bracket": b"()[]{}<>", "slash": b"/\\",
    "dash": b"-_=+~^", "at": b"@", "high": bytes(range(128, 256)),
}
CLASS_OF = np.full(256, len(CLASSES))
for _i, _bytes in enumerate(CLASSES.values()):
    CLASS_OF[list(_bytes)] = _i
N_CONTENT = 2 * (len(CLASSES) + 1) + 8
N_META = 2 * HASHED + 8
N_FEATURES = N_CONTENT + N_META


def content_features(text: str) -> np.ndarray:
    """Numbers from the whole text, none of them its length."""
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    counts = np.bincount(CLASS_OF, weights=np.bincount(raw, minlength=256), minlength=len(CLASSES) + 1)
    shares = counts / max(1, len(raw))
    words = text.split()
    n = max(1, len(words))
    seen = Counter(words)
    often = sum(c for _, c in seen.most_common(3)) / n
    repeats = sum(map(str.__eq__, words, words[1:])) / n
    shouted = sum(map(str.isupper, words)) / n
    letters = sum(map(str.isalpha, words)) / n
    longest = max(map(len, seen), default=0)
    mean = sum(map(len, words)) / n
    # A long text repeats words by nature: distinct words are measured against sqrt(n).
    distinct = len(seen) / n ** 0.5
    shape = [often, repeats, shouted, letters, np.log1p(longest), np.log1p(mean), np.log1p(distinct), float(not words)]
    return np.concatenate([shares, np.sqrt(shares), shape])


def meta_features(lang: str | None, source: str | None, n_chars: str | None, n_lines: int) -> np.ndarray:
    """Numbers from the page's metadata (as strings) and line layout."""
    out = np.zeros(N_META)
    for at, value in ((0, lang), (HASHED, source)):
        text = value if isinstance(value, str) else None
        out[at + zlib.crc32(repr(text).encode()) % HASHED] = 1.0
    known = isinstance(n_chars, str)
    size = float(np.log1p(max(0.0, np.nan_to_num(float(n_chars))))) if known else 0.0
    lines = float(np.log1p(n_lines))
    out[2 * HASHED :] = [size, size * size / 10, lines, size - lines, float(not known), float(size < 5), float(size > 9), float(size > 11)]
    return out


def features(text: str, lang, source, n_chars) -> np.ndarray:
    return np.concatenate([content_features(text), meta_features(lang, source, n_chars, text.count("\n") + 1)])


def feature_slices(*columns: pa.Array):
    """``(first row, features of TEXTS rows)`` from the columns that
    :func:`features` takes: few texts at a time become Python strings."""
    for at in range(0, len(columns[0]), TEXTS):
        rows = zip(*(c.slice(at, TEXTS).to_pylist() for c in columns), strict=True)
        yield at, np.array([features(*r) for r in rows], dtype=np.float64)


VIEWS = {"content": slice(0, N_CONTENT), "meta": slice(N_CONTENT, N_FEATURES)}


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


@dataclass(frozen=True)
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        # einsum: a row's score does not depend on the rows scored with it
        return np.einsum("ij,j->i", (x - self.mean) / self.scale, self.weights[1:]) + self.weights[0]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Logistic:
    """Ridge logistic regression by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = sigmoid(z @ w)
        step = np.linalg.solve(
            (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w
        )
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w)


def log_loss(y: np.ndarray, p: np.ndarray) -> float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


@dataclass(frozen=True)
class View:
    """One view's classifier with its Platt scaling."""

    model: Logistic
    platt: Logistic

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.platt.logit(self.model.logit(x)[:, None])


@dataclass(frozen=True)
class CoTrained:
    views: dict
    combine: Logistic

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities: text view, metadata view, combined."""
        logits = np.stack([v.logit(x[:, VIEWS[k]]) for k, v in self.views.items()], axis=1)
        return sigmoid(logits[:, 0]), sigmoid(logits[:, 1]), sigmoid(self.combine.logit(logits))


OTHER = {"content": "meta", "meta": "content"}


def pool_sums(x: np.ndarray, teachers: dict[str, View], students: dict[str, Logistic]) -> np.ndarray:
    """What the unlabelled rows ``x`` add to a Newton step of each student: for
    each view and pseudo-class the number of rows, the gradient and the Hessian
    of the log-likelihood, in one vector."""
    out = []
    for name, student in students.items():
        p = sigmoid(teachers[OTHER[name]].logit(x[:, VIEWS[OTHER[name]]]))
        z = np.hstack([np.ones((len(x), 1)), (x[:, VIEWS[name]] - student.mean) / student.scale])
        for y, sure in ((0, p <= 1 - SURE), (1, p >= SURE)):
            rows = z[sure]
            q = sigmoid(rows @ student.weights)
            hessian = (rows * np.maximum(q * (1 - q), 1e-6)[:, None]).T @ rows
            out += [np.array([float(len(rows))]), rows.T @ (y - q), hessian.ravel()]
    return np.concatenate(out)


def _split_sums(sums: np.ndarray, students: dict[str, Logistic]) -> dict[str, list[tuple[float, np.ndarray, np.ndarray]]]:
    """:func:`pool_sums` taken apart: per view, for classes 0 and 1."""
    out, at = {}, 0
    for name, student in students.items():
        d = len(student.weights)
        out[name] = []
        for _ in range(2):
            out[name].append((sums[at], sums[at + 1 : at + 1 + d], sums[at + 1 + d : at + 1 + d + d * d].reshape(d, d)))
            at += 1 + d + d * d
    return out


class ArrayPool:
    """Unlabelled documents as a matrix."""

    def __init__(self, x: np.ndarray):
        self.x = x

    def moments(self) -> tuple[int, np.ndarray, np.ndarray]:
        return len(self.x), self.x.sum(axis=0), (self.x**2).sum(axis=0)

    def sums(self, teachers: dict, students: dict) -> np.ndarray:
        return pool_sums(self.x, teachers, students)


class TablePool:
    """Unlabelled documents as a written table with their features ``x``."""

    def __init__(self, table: DataFrame):
        self.table = table

    def _summed(self, of, width: int) -> np.ndarray:
        """The sum over all rows of ``of(matrix) -> vector``: each task adds up
        its batches, and the tasks' sums are added up in ``SLOTS`` groups."""

        def run(batches):
            total = np.zeros(width)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096).column("x")
                    total += of(part.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(np.float64))
            slot = TaskContext.get().partitionId() % SLOTS
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["slot", "v"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"v": [np.sum(np.stack(pdf["v"].to_list()), axis=0)]})

        parts = self.table.select("x").mapInArrow(run, "slot int, v array<double>")
        rows = parts.groupBy("slot").applyInPandas(add, "v array<double>").toArrow()
        return matrix(rows, "v").reshape(-1, width).sum(axis=0)

    def moments(self) -> tuple[int, np.ndarray, np.ndarray]:
        def of(x: np.ndarray) -> np.ndarray:
            return np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)])

        total = self._summed(of, 1 + 2 * N_FEATURES)
        return int(total[0]), total[1 : 1 + N_FEATURES], total[1 + N_FEATURES :]

    def sums(self, teachers: dict, students: dict) -> np.ndarray:
        width = sum(2 * (1 + len(s.weights) + len(s.weights) ** 2) for s in students.values())
        return self._summed(lambda x: pool_sums(x, teachers, students), width)


def co_train(x: np.ndarray, y: np.ndarray, held: np.ndarray, pool: np.ndarray | ArrayPool | TablePool, rounds: int = ROUNDS) -> CoTrained | None:
    """``held`` marks the labelled rows kept for calibration."""
    if any(len(set(part)) < 2 for part in (y[held], y[~held])):
        return None
    pool = ArrayPool(pool) if isinstance(pool, np.ndarray) else pool
    base_x, base_y, cal_x, cal_y = x[~held], y[~held], x[held], y[held]
    n_pool, total, squares = pool.moments()
    n = n_pool + len(base_x)
    mean = (total + base_x.sum(axis=0)) / n
    scale = np.sqrt(np.maximum((squares + (base_x**2).sum(axis=0)) / n - mean**2, 0.0))
    scale = np.where(scale > 1e-6, scale, 1.0)

    def start(name: str) -> Logistic:
        cols = VIEWS[name]
        return Logistic(mean[cols], scale[cols], np.zeros(cols.stop - cols.start + 1))

    def step(name: str, student: Logistic, given: list) -> tuple[Logistic, float]:
        """One Newton step on the labelled rows and the pseudo-labels' sums."""
        z = np.hstack([np.ones((len(base_x), 1)), (base_x[:, VIEWS[name]] - student.mean) / student.scale])
        p, w = sigmoid(z @ student.weights), student.weights
        penalty = np.ones(len(w))
        penalty[0] = 1e-6
        gradient = z.T @ (base_y - p) - penalty * w
        hessian = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(penalty)
        for label, (count, g, h) in enumerate(given):
            if count:
                share = min(1.0, float((base_y == label).sum()) / count)
                gradient, hessian = gradient + share * g, hessian + share * h
        change = np.clip(np.linalg.solve(hessian, gradient), -5, 5)
        return Logistic(student.mean, student.scale, w + change), float(np.abs(change).max())

    def calibrated(name: str, model: Logistic) -> View:
        return View(model, fit_logistic(model.logit(cal_x[:, VIEWS[name]])[:, None], cal_y, ridge=0.01))

    def loss(name: str, v: View) -> float:
        return log_loss(cal_y, sigmoid(v.logit(cal_x[:, VIEWS[name]])))

    views = {}
    for name in VIEWS:
        model, change = start(name), 1.0
        for _ in range(25):
            model, change = step(name, model, [])
            if change < 1e-6:
                break
        views[name] = calibrated(name, model)
    for _ in range(rounds if n_pool else 0):
        students = {name: v.model for name, v in views.items()}
        for _ in range(STEPS):
            given = _split_sums(pool.sums(views, students), students)
            moved = {name: step(name, s, given[name]) for name, s in students.items()}
            students = {name: m for name, (m, _) in moved.items()}
            if max(change for _, change in moved.values()) < 1e-4:
                break
        changed = False
        for name, model in students.items():
            new = calibrated(name, model)
            if loss(name, new) < loss(name, views[name]) - 1e-6:
                views[name], changed = new, True
        if not changed:
            break
    logits = np.stack([views[k].logit(cal_x[:, VIEWS[k]]) for k in VIEWS], axis=1)
    return CoTrained(views, fit_logistic(logits, cal_y, ridge=0.1))


def _with_features(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """``(doc_id, y, x)`` of every row of ``docs``, written; ``y`` is the label
    of the documents in the bounded labelled sample and null for all others."""
    order = F.xxhash64("doc_id", F.lit("sample"))
    rated = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    rated = rated.groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("y"))
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = ids.join(rated, "doc_id").orderBy(order, "doc_id").limit(max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
    rows = rows.join(F.broadcast(chosen), "doc_id", "left")

    def run(batches):
        for batch in batches:
            for at, x in feature_slices(*map(batch.column, ("text", "lang", "source", "n_chars"))):
                part = batch.slice(at, len(x))
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES)
                lists = pa.ListArray.from_arrays(ends, pa.array(x.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), lists], ["doc_id", "y", "x"])

    rows = rows.select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", "n_chars")
    return stage(_plain(rows).mapInArrow(run, "doc_id long, y int, x array<float>"), "features")


def _plain(df: DataFrame) -> DataFrame:
    """Metadata as strings, as :func:`meta_features` takes them."""
    return df.withColumns({"lang": F.col("lang").cast("string"), "source": F.col("source").cast("string"), "n_chars": F.col("n_chars").cast("string")})


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> CoTrained | None:
    table = _with_features(docs, labels, max_labelled)
    # At most max_labelled rows: repeated rows of an id count once.
    known = table.where("y is not null").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("x").alias("x")).orderBy("doc_id").toArrow()
    y, x = known.column("y").to_numpy().astype(float), matrix(known, "x").reshape(-1, N_FEATURES)
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 0 for i in known.column("doc_id").to_pylist()], dtype=bool)
    return co_train(x, y, held, TablePool(table.where("y is null")))


def score_quality(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """``docs`` with ``__llm_p_content``, ``__llm_p_meta`` and ``__llm_p``, the probabilities of good quality."""
    names = ["__llm_p_content", "__llm_p_meta", "__llm_p"]
    if model is None:
        return docs.withColumns({c: F.lit(1.0) for c in names})

    @F.arrow_udf("struct<c double, m double, p double>")
    def run(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        scores = [model.score(x) for _, x in feature_slices(text, lang, source, n_chars)]
        columns = [np.concatenate(c) for c in zip(*scores, strict=True)] or [np.empty(0)] * 3
        return pa.StructArray.from_arrays(list(map(pa.array, columns)), list("cmp"))

    p = run(F.coalesce("text", F.lit("")), *[F.col(c).cast("string") for c in ("lang", "source", "n_chars")])
    scored = docs.withColumn("__llm_s", p)
    return scored.withColumns(dict(zip(names, [F.col(f"__llm_s.{c}") for c in "cmp"], strict=True))).drop("__llm_s")


def keep_good(docs: DataFrame, labels: DataFrame, min_quality: float = 0.5) -> DataFrame:
    """``docs`` without those whose combined probability is below ``min_quality``."""
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.where(F.col("__llm_p") >= min_quality).select(*[F.col(f"`{c}`") for c in docs.columns])
