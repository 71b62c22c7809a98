from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from increload.llm import quality
from increload.llm.quality import N_FEATURES, co_train, features, fit_quality, keep_good, score_quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    """Trained on half of the labels, measured on the other half."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = fit_quality(docs, labels.where("doc_id % 2 = 0"))
    rows = score_quality(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "__llm_p", "__llm_p_content").collect()
    y, p = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert ((p >= 0.5) == y).mean() > 0.97
    assert (p[y == 1] >= 0.5).mean() > 0.985  # clean documents stay
    assert abs(p.mean() - y.mean()) < 0.03  # calibrated
    again = fit_quality(docs.repartition(3), labels.where("doc_id % 2 = 0"))
    assert np.allclose(again.combine.weights, model.combine.weights)


def test_views_teach_each_other():
    """A metadata view that is informative for half of the pages learns from the text view's pseudo-labels."""
    rng = np.random.default_rng(0)
    n, y = 3000, rng.integers(0, 2, 3000)
    x = rng.normal(size=(n, N_FEATURES)) * 0.1
    x[:, 0] = y + rng.normal(size=n) * 0.15
    x[:, -1] = y + rng.normal(size=n) * 0.6
    known = np.arange(n) < 120
    held = np.arange(120) % 3 == 0
    model = co_train(x[known], y[known].astype(float), held, x[~known])
    alone = co_train(x[known], y[known].astype(float), held, x[~known][:0])
    _, meta, both = model.score(x[~known])
    _, meta_alone, _ = alone.score(x[~known])
    assert ((both >= 0.5) == y[~known]).mean() > 0.97
    assert ((meta >= 0.5) == y[~known]).mean() >= ((meta_alone >= 0.5) == y[~known]).mean()


def test_no_usable_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 0), (3, None, 0), (5, 7, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        assert fit_quality(odd_docs, labels) is None
        assert keep_good(odd_docs, labels).count() == odd_docs.count()
    assert keep_good(no_docs, none).collect() == []


def test_odd_documents(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_quality(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    rows = score_quality(odd_docs, model)
    assert rows.columns[: len(odd_docs.columns)] == odd_docs.columns
    scores = [r["__llm_p"] for r in rows.collect()]
    assert len(scores) == odd_docs.count() and all(0 <= s <= 1 for s in scores)


@pytest.mark.parametrize("text", ["", " ", "x" * 100_000, "a\n" * 1000, "é😀"])
def test_features_are_finite(text):
    for meta in ((None, None, None), ("en", "s", "12"), ("en", float("nan"), "NaN")):
        x = features(text, *meta)
        assert x.shape == (N_FEATURES,) and np.isfinite(x).all()


def plain_co_train(x, y, held, pool, rounds=4, steps=6):
    """The exchange with explicit training rows: labelled ones and, each with
    its class's share, every unlabelled one that the other view is sure of."""
    from increload.llm.quality import SURE, VIEWS, Logistic, View, fit_logistic, log_loss, sigmoid

    bx, by, cx, cy = x[~held], y[~held], x[held], y[held]
    everything = np.vstack([bx, pool])
    mean, scale = everything.mean(axis=0), everything.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0)

    def newton(w, rows, labels, weights):
        z = np.hstack([np.ones((len(rows), 1)), rows])
        p = sigmoid(z @ w)
        penalty = np.ones(len(w))
        penalty[0] = 1e-6
        h = sum(a * max(q * (1 - q), 1e-6) * np.outer(r, r) for a, q, r in zip(weights, p, z)) + np.diag(penalty)
        return np.clip(np.linalg.solve(h, sum(a * (t - q) * r for a, t, q, r in zip(weights, labels, p, z)) - penalty * w), -5, 5)

    def scaled(rows, name):
        return (rows[:, VIEWS[name]] - mean[VIEWS[name]]) / scale[VIEWS[name]]

    def view(name, w):
        model = Logistic(mean[VIEWS[name]], scale[VIEWS[name]], w)
        return View(model, fit_logistic(model.logit(cx[:, VIEWS[name]])[:, None], cy, ridge=0.01))

    def loss(name, v):
        return log_loss(cy, sigmoid(v.logit(cx[:, VIEWS[name]])))

    views = {}
    for name in VIEWS:
        w = np.zeros(VIEWS[name].stop - VIEWS[name].start + 1)
        for _ in range(25):
            change = newton(w, scaled(bx, name), by, np.ones(len(by)))
            w = w + change
            if np.abs(change).max() < 1e-6:
                break
        views[name] = view(name, w)
    for _ in range(rounds):
        weights = {name: v.model.weights for name, v in views.items()}
        sets = {}
        for name, other in (("content", "meta"), ("meta", "content")):
            p = sigmoid(views[other].logit(pool[:, VIEWS[other]]))
            good, bad = np.flatnonzero(p >= SURE), np.flatnonzero(p <= 1 - SURE)
            rows = np.vstack([scaled(bx, name), scaled(pool[bad], name), scaled(pool[good], name)])
            labels = np.concatenate([by, np.zeros(len(bad)), np.ones(len(good))])
            share = [min(1, (by == c).sum() / max(1, n)) for c, n in ((0, len(bad)), (1, len(good)))]
            sets[name] = rows, labels, np.concatenate([np.ones(len(by)), np.full(len(bad), share[0]), np.full(len(good), share[1])])
        for _ in range(steps):
            changes = {name: newton(weights[name], *sets[name]) for name in VIEWS}
            weights = {name: weights[name] + changes[name] for name in VIEWS}
            if max(np.abs(c).max() for c in changes.values()) < 1e-4:
                break
        changed = False
        for name in VIEWS:
            new = view(name, weights[name])
            if loss(name, new) < loss(name, views[name]) - 1e-6:
                views[name], changed = new, True
        if not changed:
            break
    return views


def _pages(n, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, N_FEATURES)) * 0.1
    x[:, 0] = y + rng.normal(size=n) * 0.25
    x[:, -1] = y + rng.normal(size=n) * 0.4
    x[:, 5] = 0.5  # a constant feature
    return x.astype(np.float32).astype(np.float64), y


def test_exchange_equals_plain_co_training(spark):
    from increload.llm.quality import ArrayPool, TablePool

    x, y = _pages(700)
    held = np.arange(160) % 4 == 0
    args = x[:160], y[:160].astype(float), held
    table = spark.createDataFrame([(r.tolist(),) for r in x[160:]], "x array<float>").repartition(5)
    want = plain_co_train(*args, x[160:])
    for pool in (x[160:], ArrayPool(x[160:]), TablePool(table)):
        got = co_train(*args, pool).views
        for name in want:
            assert np.allclose(got[name].model.weights, want[name].model.weights, rtol=1e-6, atol=1e-8)
            assert np.allclose(got[name].platt.weights, want[name].platt.weights, rtol=1e-6, atol=1e-8)
    alone = co_train(*args, x[:0]).views
    assert any(not np.allclose(alone[n].model.weights, want[n].model.weights, atol=1e-3) for n in want)  # the exchange did something


def test_every_unlabelled_document_takes_part(spark):
    from pyspark.sql import functions as F

    from increload.llm.quality import ArrayPool, TablePool, _split_sums

    x, y = _pages(160, seed=1)
    views = co_train(x, y.astype(float), np.arange(160) % 4 == 0, x[:0]).views
    students = {name: v.model for name, v in views.items()}
    kind = F.when(F.col("id") % 2 == 0, F.lit(1.5)).otherwise(F.lit(-0.5)) + F.col("id") / 1e6
    cells = [kind if i in (0, N_FEATURES - 1) else F.lit(0.5 if i == 5 else 0.0) for i in range(N_FEATURES)]
    table = spark.range(45_000, numPartitions=7).select(F.array(*[c.cast("float") for c in cells]).alias("x"))
    pool = TablePool(table)
    n, total, _ = pool.moments()
    matrix = np.array([r["x"] for r in table.collect()], dtype=np.float64)
    assert n == 45_000 and np.allclose(total, matrix.sum(axis=0))
    sums = pool.sums(views, students)
    assert np.allclose(sums, ArrayPool(matrix).sums(views, students), rtol=1e-9)
    counts = {name: [c for c, _, _ in parts] for name, parts in _split_sums(sums, students).items()}
    assert counts == {"content": [22_500, 22_500], "meta": [22_500, 22_500]}


def test_documents_beyond_the_labelled_bound_are_unlabelled(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    from increload.llm.quality import _with_features

    table = _with_features(docs.unionByName(docs.where("doc_id % 2 = 0")).selectExpr("*", "0 AS y", "1 AS x"), labels, 50)
    assert table.where("y is not null").select("doc_id").distinct().count() == 50
    assert table.count() == docs.count() + docs.where("doc_id % 2 = 0").count()


def test_few_texts_at_a_time_become_strings():
    """A batch of texts is turned into numbers slice by slice, equal to all at once."""
    n = 1000
    columns = [[f"text {i} " + "é " * (i % 5) for i in range(n)], [None, "en"] * (n // 2), ["a"] * n, [None if i % 3 else str(i) for i in range(n)]]
    slices = list(quality.feature_slices(*map(pa.array, columns)))
    assert [at for at, _ in slices] == list(range(0, n, quality.TEXTS)) and max(len(x) for _, x in slices) <= 256
    whole = np.array([quality.features(*r) for r in zip(*columns)])
    assert np.array_equal(np.concatenate([x for _, x in slices]), whole)
