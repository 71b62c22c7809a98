from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from increload.llm.pii import BASE, KINDS, LOOSE, _count, count_kind, find_personal_data, fit, redact, span_text, with_base_spans, with_candidates

# The base patterns as the contract writes them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, ch in enumerate(reversed(d)):
        v = int(ch) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PLAIN[kind], text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else None,
                "card": 13 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def found(df):
    rows = find_personal_data(df)
    cols = [span_text(F.col("base")).alias("base"), span_text(F.col("spans")).alias("spans"), *[count_kind("base", k).alias(k) for k in KINDS]]
    return rows.select("doc_id", *cols).collect()


TRICKY = [
    "a@b.c_d@e.f x@y z@w.q. aa@bb..cc",
    "1.2.3.4.5.6.7.8 300.1.1.1 1.2.3 0001.02.3.255 1.2.3.256 999999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111111 4111111111111111",
    "+1 (269) 555-3296 4524132264652800 +49 30 1234567 ++12 3 +1-2 +123456789012345 +1234567890123456",
    "😀😀 é+1 (269) 555-3296😀 ü@x.y é1.2.3.4ö",
    "mail joe (at) example.com or call 269-555-3296 now, +1 269 555 3296",
    "",
    None,
    "@" * 300 + "a" * 3000 + "1 " * 3000 + "." * 500 + "a@b" * 200,
]


def test_base_spans_follow_the_plain_patterns(spark):
    rng = random.Random(3)
    texts = TRICKY + ["".join(rng.choices("a@.1+ 25-(é😀\n", k=rng.randint(1, 120))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in found(df):
        want = base_spans(texts[r["doc_id"]])
        assert r["base"] == want, texts[r["doc_id"]]
        kinds = [s.split(":")[0] for s in want.split(",")]
        assert [r[k] for k in KINDS] == [kinds.count(k) for k in KINDS]
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def test_documents(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = found(docs)
    assert len(rows) == len(texts)
    assert {r["doc_id"]: r["base"] for r in rows} == {i: base_spans(t) for i, t in texts.items()}


def test_odd_documents(odd_docs, no_docs):
    rows = found(odd_docs)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd_docs.collect())
    assert all(r["base"] == r["spans"] == "" for r in rows)
    assert found(no_docs) == []


def planted(n=480):
    rng = random.Random(9)
    out = []
    for i in range(n):
        words = [rng.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(30)]
        if i % 2:
            phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
            words[10] = phone + (" 4524132264652800" if i % 80 == 1 else "")  # the base pattern runs on and fails
        elif i % 4 == 0:
            words[10] = f"{rng.randint(10, 99)}-{rng.randint(100, 999)}"
        out.append((i, " ".join(words)))
    return out


def test_boosted_trees_add_what_the_base_patterns_miss(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in found(df)}
    missed = [i for i, t in rows if i % 80 == 1]
    for i in missed:
        text = dict(rows)[i]
        assert "phone" not in got[i]["base"]
        at = text.index("+1 (")
        assert any(s.startswith("phone:") and int(s.split(":")[1]) <= at + 1 for s in got[i]["spans"].split(","))
    assert all(got[i]["spans"] == "" for i, _ in rows if i % 2 == 0)


def test_scores_as_columns_equal_scores_in_python(spark):
    df = spark.createDataFrame(planted(), "doc_id long, text string")
    cands = with_candidates(with_base_spans(df, ["doc_id"])).withColumn("key", F.xxhash64("text"))
    counts = _count(cands.select("key", "cands"))
    model = fit(counts)
    rows = cands.select(F.explode("cands").alias("c")).select("c.f", model.score(F.col("c.f")).alias("s")).collect()
    assert rows
    for r in rows[:200]:
        f = r["f"].asDict()
        assert abs(r["s"] - model.start - sum(t.value(f) if hasattr(t, "value") else t for t in model.trees)) < 1e-9


def test_one_class_fits_nothing():
    assert fit([]) is None


def test_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "to a@b.c, 1.2.3.4 é", "x"), (2, "clean", "y"), (3, None, "z")], "doc_id long, text string, spans string")
    out = redact(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: (r["text"], r["spans"]) for r in out.collect()} == {1: ("to [email], [ip] é", "x"), 2: ("clean", "y"), 3: (None, "z")}


def test_patterns_compile_in_java(spark):
    for p in [*BASE.values(), *LOOSE.values()]:
        assert spark.range(1).select(F.regexp_count(F.lit("x"), F.lit(p))).first()[0] == 0
    digest = hashlib.sha256(b"").hexdigest()
    assert spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0] == digest


def card(rng, valid=True):
    """Sixteen digits in four groups with dots, which the base pattern takes apart."""
    body = [rng.randint(1, 9) for _ in range(15)]
    odd = sum(d * 2 - 9 * (d > 4) for d in body[::2])
    body.append((-odd - sum(body[1::2])) % 10)
    if not valid:
        body[-1] = (body[-1] + 3) % 10
    return ".".join("".join(map(str, body[i : i + 4])) for i in range(0, 16, 4))


def obfuscated(n=600):
    rng = random.Random(4)

    def octets():
        return [str(rng.randint(1, 255)) for _ in range(4)]

    forms = [
        ("email", lambda: f"{rng.choice(['joe', 'ann', 'max'])}{rng.randint(1, 99)} (at) mail (dot) com"),
        ("ip", lambda: " . ".join(octets())),
        ("card", lambda: card(rng)),
        ("phone", lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"),
        ("", lambda: str(rng.randint(10**9, 10**10 - 1))),
    ]
    for i in range(n):
        kind, make = forms[i % len(forms)]
        span = make()
        yield i, kind, span, f"lorem ipsum dolor {span} sit amet"


def test_frequent_obfuscated_forms_are_added(spark):
    rows = list(obfuscated())
    got = {r["doc_id"]: r for r in found(spark.createDataFrame([(i, text) for i, _, _, text in rows], "doc_id long, text string"))}
    for i, kind, span, text in rows:
        at = text.index(span)
        assert got[i]["base"] == ""
        start = at - (kind == "phone")  # the loose phone pattern takes the blank before a number along
        assert got[i]["spans"] == (f"{kind}:{start}:{at + len(span)}" if kind else ""), text


def test_base_spans_of_long_texts_take_time_in_proportion(spark):
    """A log of numbers, a million characters long: every number is a match of
    the card pattern, each line holds an address and a phone number."""
    import time

    lines = [f"{i} took {i * 37 % 1000} of {i * 91 % 100000} ms, host 10.{i % 256}.{i * 7 % 256}.{i % 300}, call +49 30 {1000000 + i}" for i in range(16_000)]
    text = "\n".join(lines)
    assert len(text) > 1_000_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
    began = time.time()
    row = with_base_spans(df, ("doc_id",)).select(*[f"base_{k}" for k in KINDS]).first()
    took = time.time() - began
    got = ",".join(f"{k}:{x['s']}:{x['e']}" for k in KINDS for x in row[f"base_{k}"])
    assert got == base_spans(text) and got.count(",") > 25_000
    assert took < 60
