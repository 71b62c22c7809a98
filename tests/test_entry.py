"""The driver contract: entry smoke run, queries vs their DuckDB oracles."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "event_id" in df.columns and "day" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cols = df.columns
    got = Counter(tuple(_norm(r[c]) for c in sorted(cols)) for r in df.collect())
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(ocols)
    idx = [ocols.index(c) for c in sorted(cols)]
    want = Counter(tuple(_norm(r[i]) for i in idx) for r in res.fetchall())
    assert got == want


def test_entry_works_without_the_corpus_operators():
    """The corpus subpackage and its pipeline may be taken away."""
    import subprocess
    import sys

    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['increload.llm'] = None\n"
        "import __spark_entry__ as E\n"
        "assert 'pipeline' not in E.queries() and not any(q.startswith('op') for q in E.queries())\n"
        "assert set(E.oracle_sql()) == set(E.queries())\n"
    )
    root = E.__file__.rsplit("/", 1)[0]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_operators():
    import pathlib

    root = pathlib.Path(E.__file__).parent
    for path in [*(root / "increload").rglob("*.py"), *(root / "tools").glob("*.py"), root / "bench.py"]:
        if "llm" not in path.parts:
            assert "increload.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
