from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from increload.llm.licences import ANCHORS, HEADER_LINES, LICENCE_FILE, NOTICES, SEGMENT, TEMPLATES, TERM, scan_licences


def plain(files, threshold=0.6):
    """Multiset of (path, licences, own, licence, cosine, from_dir)."""
    def terms(t):
        return re.findall(TERM, t.lower())

    def java(p):
        return re.compile(p.replace("(?i)", ""), re.I)

    hits = defaultdict(dict)
    segs = {}
    for f, (path, text) in enumerate(files):
        for n, line in enumerate((text or "").split("\n")):
            if java(SEGMENT).search(line):
                segs[(f, n)] = terms(line)
    df, total = Counter(), len(segs)
    for t in segs.values():
        df.update(set(t))
    known = {w for _, t in TEMPLATES for w in terms(t)}
    idf = {w: math.log((total + 1) / (df[w] + 1)) + 1 for w in set(df) | known}

    def vec(ts):
        x = {w: (1 + math.log(c)) * idf[w] for w, c in Counter(ts).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {w: v / norm for w, v in x.items()}

    goals = [(spdx, vec(terms(t))) for spdx, t in TEMPLATES]
    for (f, n), ts in segs.items():
        x = vec(ts)
        best = max(((round(sum(x.get(w, 0) * v for w, v in g.items()), 9), -i, spdx) for i, (spdx, g) in enumerate(goals)), default=None)
        if best and best[0] >= threshold:
            hits[f][n] = (best[2], best[0])
    paths = [p or "" for p, _ in files]
    dirs = [re.sub(r"/?[^/]*$", "", p) for p in paths]
    own = {f: max((c, -n, s) for n, (s, c) in h.items()) for f, h in hits.items()}
    given = {}
    for f, h in hits.items():
        if min(h) < HEADER_LINES or java(LICENCE_FILE).search(paths[f]):
            c, _, s = own[f]
            given[dirs[f]] = max(given.get(dirs[f], (0, "")), (c, s))
    out = Counter()
    for f, path in enumerate(paths):
        if f in own:
            c, _, s = own[f]
            out[(path, tuple(sorted({s for s, _ in hits[f].values()})), True, s, round(c, 6), None)] += 1
            continue
        d, found = dirs[f], None
        while True:
            if d in given:
                found = d
                break
            if not d:
                break
            d = d.rpartition("/")[0]
        c, s = given[found] if found is not None else (None, None)
        out[(path, (), False, s, None if c is None else round(c, 6), found)] += 1
    return out


def result(df, path):
    rows = scan_licences(df, path).collect()
    return Counter(
        (r["path"], tuple(r["licences"]), r["own"], r["licence"], None if r["cosine"] is None else round(r["cosine"], 6), r["from_dir"]) for r in rows
    )


TREE = [
    ("LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("src/a.py", "print(1)"),
    ("src/vendor/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nGNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("src/vendor/x/y/z.c", "int main"),
    ("src/vendor/x/own.c", "// Licensed under the Apache License, Version 2.0\nint f;"),
    ("src/vendor/x/deep/k.c", "int g;"),
    ("src/vendor/w/q.c", "int q;"),
    ("docs/late.txt", "\n" * 30 + "Licensed under CC BY-NC 4.0."),
    ("docs/other.txt", "text with a licence of nothing in particular, and a driving licence besides"),
    ("docs/other.txt", "text with a licence of nothing in particular, and a driving licence besides"),
    ("docs/both.txt", "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."),
    ("top.txt", ""),
    (None, None),
]


def test_tree(spark):
    df = spark.createDataFrame(TREE, "path string, text string")
    got = result(df, F.col("path"))
    assert got == plain(TREE)
    by_path = {k[0]: k for k in got}
    assert by_path["src/a.py"][3] == "MIT" and by_path["src/a.py"][5] == ""
    assert by_path["src/vendor/w/q.c"][3] == "GPL-3.0" and by_path["src/vendor/w/q.c"][5] == "src/vendor"
    assert by_path["src/vendor/x/y/z.c"][3] == "Apache-2.0" and by_path["src/vendor/x/y/z.c"][5] == "src/vendor/x"
    assert by_path["src/vendor/x/deep/k.c"][3] == "Apache-2.0" and by_path["src/vendor/x/deep/k.c"][5] == "src/vendor/x"
    assert by_path["docs/late.txt"][2:4] == (True, "CC-BY-NC-4.0")
    assert by_path["docs/both.txt"][1] == ("CC-BY-NC-4.0", "MIT")


def test_documents(docs):
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    files = [(f"{r['source']}/{r['lang']}/{r['doc_id']}", r["text"]) for r in docs.collect()]
    assert result(docs, path) == plain(files)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = scan_licences(odd_docs, F.col("source"), carry=("doc_id",)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd_docs.collect())
    assert all(r["licence"] is None for r in rows)
    assert scan_licences(no_docs, F.col("source")).collect() == []


PROSE = "the ordinary words of a long paragraph that says nothing of interest about anybody in particular and goes on for a while. "
GPL_HEADER = """/* tool.c
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU {}General Public License as published by
 * the Free Software Foundation; either version {} of the License, or
 * (at your option) any later version.
 */"""


ANYWHERE = [
    ("// SPDX-License-Identifier: MIT", ["MIT"]),
    ("# SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]),
    ("/* SPDX-License-Identifier: GPL-2.0-only */", ["GPL-2.0"]),
    ("SPDX-License-Identifier: (mit OR GPL-3.0-or-later WITH Classpath-exception-2.0) AND Zlib", ["GPL-3.0", "MIT", "Zlib"]),
    ("SPDX-License-Identifier: BSD-3-Clause some words after it", ["BSD-3-Clause"]),
    (PROSE * 5 + "Released under the MIT License. " + PROSE * 5, ["MIT"]),
    (PROSE * 5 + "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0. " + PROSE, ["Apache-2.0", "CC-BY-NC-4.0"]),
    (GPL_HEADER.format("", 2), ["GPL-2.0"]),
    (GPL_HEADER.format("", 3), ["GPL-3.0"]),
    (GPL_HEADER.format("Lesser ", "2.1"), ["LGPL-2.1"]),
    (" * it under the terms of the GNU General Public License as published by", ["GPL"]),
    ("#  Licensed under the\n#  Apache License,\n#  Version 2.0 (the thing)", ["Apache-2.0"]),
    ("Permission is hereby granted, free of charge, to any person\nobtaining a copy of\nthis software and more", ["MIT"]),
    ("This is free and unencumbered software released into the public\ndomain.", ["Unlicense"]),
    (PROSE + "released under the GPL license, not under the MIT one; his driving license has version 3. " + PROSE, []),
]


def test_notices_anywhere(spark):
    """Beside 300 files with one common notice, whose terms must not sink."""
    files = [(f"f/{i}", text) for i, (text, _) in enumerate(ANYWHERE)] + [(f"c/{i}", "Released under the MIT License.") for i in range(300)]
    rows = scan_licences(spark.createDataFrame(files, "path string, text string"), F.col("path")).where("path like 'f/%'").collect()
    got = {r["path"]: r["licences"] for r in rows}
    assert got == {f"f/{i}": want for i, (_, want) in enumerate(ANYWHERE)}


def test_every_template_has_an_anchor():
    assert all(set(re.findall(TERM, text.lower())) & set(ANCHORS) for _, text in TEMPLATES + NOTICES)
