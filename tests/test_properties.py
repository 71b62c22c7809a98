"""Random batches against a brute-force model of the load."""

from __future__ import annotations

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from increload import incremental_load

S = "part int, k string, v string"

parts = st.one_of(st.none(), st.integers(0, 2))
keys = st.one_of(st.none(), st.sampled_from(["a", "b", "c"]))
vals = st.sampled_from(["x", "y", "z"])
row = st.tuples(parts, keys, vals)


def model(batch, master, scope, order_by):
    ident = (lambda r: (r[0], r[1])) if scope == "partition" else (lambda r: (r[1],))
    known = {ident(r) for r in master}
    best = {}
    for r in batch:
        i = ident(r)
        rank = (_nf(r[2]), _nf(r[0])) if scope == "global" else (_nf(r[2]),)
        if i not in best or rank < best[i][0]:
            best[i] = (rank, r)
    return Counter(r for i, (_, r) in best.items() if i not in known)


def _nf(x):
    """Spark's ascending order: nulls first."""
    return (0, 0) if x is None else (1, x)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    batch=st.lists(row, min_size=0, max_size=12),
    master=st.lists(row, min_size=1, max_size=8),
    scope=st.sampled_from(["partition", "global"]),
    indexed=st.booleans(),
)
def test_load_matches_model(spark, batch, master, scope, indexed):
    b = spark.createDataFrame(batch, S)
    m = spark.createDataFrame(master, S)
    index = m.select("part", "k").distinct() if indexed else None
    order = ["v", "part"] if scope == "global" else ["v"]
    res = incremental_load(b, m, index, "part", ["k"], order_by=order, scope=scope)
    got = Counter(tuple(r) for r in res.delta.collect())
    assert got == model(batch, master, scope, order)
    # the merged index is the known keys plus the delta's keys, without repeats
    idx = Counter(tuple(r) for r in res.index.collect())
    assert all(c == 1 for c in idx.values()) or not indexed
    want = {(r[0], r[1]) for r in master} | {(r[0], r[1]) for r in got}
    assert set(idx) == want
