"""Licence scan: sparse TF-IDF cosine to templates, then directory inheritance.

Three searches find the notices of a file, over its whole text:

* Every line that contains a licence term is a segment, compared with the
  templates under document frequencies counted over all segments.
* Every anchor term (``ANCHORS``), wherever it stands, lays each template that
  holds it over the text, term on term: the window is as long as the template
  and is compared with it.  Lines and sentences do not matter, so notices
  inside paragraphs or wrapped over comment lines are found.  Weights come from
  the templates alone, so a notice does not sink as it becomes common, and a
  window must hold the names and version numbers of its template and no others.
* The identifiers of SPDX tags are licences, with cosine 1.

A notice counts if its cosine reaches ``threshold``.  Segments and templates
are sparse TF-IDF vectors joined on the term.  A file's licences are those of
its notices; a GNU licence without a version counts only if no version of it is
found.  A file that declares one in its first lines, or is named like a licence
file, gives it to its directory, and a file without a licence of its own
inherits from its nearest ancestor directory that has one.

A term's postings on the template side are at most the number of templates;
the segment side is never joined with itself.  A window is cut from the
terms around its anchor, a fixed number,, so a long text is never copied.

Defined results: a null text counts as empty, a null path as a file in the
root directory.  Each input row gives one row, repeated rows too.  Extra
columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from increload.llm.common import stage, text_or_empty

# Notices by which public licences are declared (SPDX id, text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
# Further notices, for windows only: headers as they are wrapped, and the titles of whole licences.
NOTICES = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Licensed under the Apache License 2.0"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Licensed under the terms of the MIT License"),
    ("MIT", "Distributed under the MIT License"),
    ("MIT", "available under the MIT License"),
    ("MIT", "This project is licensed under the MIT License"),
    ("ISC", "Licensed under the ISC License"),
    ("BSD-3-Clause", "Licensed under the BSD 3 Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2 Clause License"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("EPL-2.0", "under the terms of the Eclipse Public License v. 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "Mozilla Public License, v. 2.0"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution ShareAlike 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution NonCommercial 4.0 International"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution NoDerivatives 4.0 International"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution NonCommercial ShareAlike 4.0 International"),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution NonCommercial NoDerivatives 4.0 International"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
) + tuple(
    (licence, form.format(name=name, version=version))
    for spdx, name, versions in (("GPL", "", ("2", "3")), ("LGPL", "Lesser", ("2.1", "3")), ("AGPL", "Affero", ("3",)))
    for version in versions
    for licence in [f"{spdx}-{version if '.' in version else version + '.0'}"]
    for form in (
        "GNU {name} General Public License version {version}",
        "GNU {name} General Public License v{version}",
        "GNU {name} General Public License v{version}.0",
        "under the terms of the GNU {name} General Public License as published by the Free Software Foundation, either version {version} of the License",
        "under the terms of version {version} of the GNU {name} General Public License as published by the Free Software Foundation",
    )
) + tuple(
    (spdx, f"under the terms of the GNU {name} General Public License as published by")
    for spdx, name in (("GPL", ""), ("LGPL", "Lesser"), ("AGPL", "Affero"))
)
ANCHORS = ("license", "licensed", "permission", "redistribution", "gnu", "cc", "cc0", "commons", "apache", "mozilla", "unencumbered")
# Terms that tell one licence from another; numbers do too.
NAMES = (
    "apache", "mit", "isc", "bsd", "boost", "eclipse", "mozilla", "gnu", "lesser", "library", "affero", "cc", "cc0", "nc", "sa", "nd",
    "noncommercial", "sharealike", "noderivatives", "noderivs", "attribution", "commons", "unencumbered", "organization",
)
NUMBER = r"^v?[0-9]+(?:\.[0-9]+)*$"
ANCHORED = r"(?i)licen[sc]e|permission|redistribution|\bgnu\b|\bcc\b|\bcc0\b|commons|apache|mozilla|unencumbered"
TAG = r"(?i)SPDX-License-Identifier:[\x20\t]*([A-Za-z0-9.+()\x20\t:-]+)"
SEGMENT = r"(?i)licen[sc]|copying|permission|redistribution|public domain|\bcc0\b|\bcc by|spdx"
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[sc]e|copying|unlicense)[^/]*$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
HEADER_LINES = 3


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def _vectors(texts: DataFrame, id_col: str, weights: DataFrame) -> DataFrame:
    """``(id, term, x)``: unit TF-IDF vectors; a term's weight comes from ``weights``."""
    counted = texts.select(id_col, F.explode("terms").alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = counted.join(weights, "term").withColumn("x", (1 + F.log(F.col("tf").cast("double"))) * F.col("idf"))
    norm = raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, id_col).select(id_col, "term", (F.col("x") / F.col("norm")).alias("x"))


def licence_segments(files: DataFrame, threshold: float) -> DataFrame:
    """``(file, line, licence, cosine)`` for the segments that match a
    template.  ``files`` holds ``file`` (its key) and ``text``."""
    spark = files.sparkSession
    text = text_or_empty()
    lines = files.where(text.rlike(SEGMENT)).select("file", F.posexplode(F.split(text, "\n", -1)).alias("line", "raw"))
    found = lines.where(F.col("raw").rlike(SEGMENT)).select("file", "line", _terms(F.col("raw")).alias("terms"))
    # The segment's distinct text stands for all its copies: a notice that is
    # in every file is scored once.
    found = stage(found.withColumn("seg", F.concat_ws(" ", "terms")), "segments")
    distinct = stage(found.groupBy("seg").agg(F.first("terms").alias("terms"), F.count(F.lit(1)).alias("copies")), "distinct")
    templates = spark.createDataFrame([(i, spdx, words) for i, (spdx, words) in enumerate(TEMPLATES)], "template int, licence string, words string")
    templates = templates.select("template", "licence", _terms(F.col("words")).alias("terms"))

    total = distinct.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n"))
    df = distinct.select("copies", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.sum("copies").alias("df"))
    n = float(total.first()[0])
    known = templates.select(F.explode("terms").alias("term")).distinct()
    idf = (F.log((n + 1) / (F.coalesce(F.col("df"), F.lit(0)) + 1)) + 1).alias("idf")
    # Terms outside the templates are as rare as can be: they keep a segment's
    # norm large, so running text that mentions a licence stays dissimilar.
    weights = stage(df.join(known, "term", "full").select("term", idf), "idf")
    segments = _vectors(distinct, "seg", weights)
    goal = _vectors(templates, "template", weights).join(templates.select("template", "licence"), "template")
    cosine = (
        segments.alias("s").join(goal.alias("t"), "term").groupBy("seg", "template", "licence")
        .agg(F.round(F.sum(F.col("s.x") * F.col("t.x")), 9).alias("cosine"))
    )
    best = cosine.groupBy("seg").agg(F.max(F.struct("cosine", (-F.col("template")).alias("order"), "licence")).alias("b"))
    best = best.where(F.col("b.cosine") >= threshold).select("seg", "b.licence", "b.cosine")
    return found.select("file", "line", "seg").join(best, "seg").select("file", "line", "licence", "cosine")


def _window_templates() -> tuple[list[tuple], list[tuple], float]:
    """The window search's templates ``(template, licence, anchor, at, len, named)``,
    one row per anchor, their vectors' ``(term, idf)`` and the idf of a term of no template."""
    words = [(spdx, re.findall(TERM, text.lower())) for spdx, text in TEMPLATES + NOTICES]
    df: dict[str, int] = {}
    for _, terms in words:
        for t in set(terms):
            df[t] = df.get(t, 0) + 1
    idf = [(t, math.log((len(words) + 1) / (n + 1)) + 1) for t, n in sorted(df.items())]
    rows = [
        (i, spdx, t, at, len(terms), sorted({x for x in terms if x in NAMES or re.match(NUMBER, x)}))
        for i, (spdx, terms) in enumerate(words) for at, t in enumerate(terms) if t in ANCHORS
    ]
    return rows, idf, math.log(len(words) + 1) + 1


def licence_windows(files: DataFrame, threshold: float) -> DataFrame:
    """``(file, line, licence, cosine)`` for the windows of the texts that match
    a template; ``line`` is the one in which the window begins."""
    spark = files.sparkSession
    laid, idf, rare = _window_templates()
    span = max(r[4] for r in laid)
    lines = F.split(F.regexp_replace(F.lower(text_or_empty()), "licenc", "licens"), "\n", -1)
    words = F.flatten(F.transform(lines, lambda x, i: F.transform(_terms(x), lambda t: F.struct(t.alias("term"), i.alias("line")))))
    texts = files.where(text_or_empty().rlike(ANCHORED)).select("file", words.alias("words"))
    places = F.filter(F.transform("words", lambda w, i: F.when(w["term"].isin(*ANCHORS), i)), lambda i: i.isNotNull())
    around = F.transform(places, lambda i: F.struct(
        F.col("words")[i]["term"].alias("anchor"), i.alias("place"), F.least(i, F.lit(span)).alias("lead"),
        F.slice("words", F.greatest(i - span, F.lit(0)) + 1, F.lit(2 * span)).alias("near"),
    ))
    anchors = texts.select("file", F.explode(around).alias("a")).select("file", "a.*")
    # One row per anchor of a template, a fixed number.
    templates = spark.createDataFrame(laid, "template int, licence string, anchor string, at int, len int, named array<string>")
    first = F.greatest(F.col("lead") - F.col("at"), F.lit(0))
    window = F.slice("near", first + 1, F.col("len") + F.least(F.col("lead") - F.col("at"), F.lit(0)))
    cut = anchors.join(F.broadcast(templates), "anchor").select("file", "template", "licence", "named", window.alias("w"))
    cut = cut.select("file", "template", "licence", "named", F.col("w")[0]["line"].alias("line"), F.col("w.term").alias("terms"))
    named = F.filter(F.array_distinct("terms"), lambda t: t.isin(*NAMES) | t.rlike(NUMBER))
    cut = cut.where(F.array_sort(named) == F.col("named")).withColumn("seg", F.concat_ws(" ", F.col("template").cast("string"), "terms"))
    cut = stage(cut.select("file", "template", "licence", "line", "seg", "terms").distinct(), "windows")

    weights = spark.createDataFrame(idf, "term string, idf double")
    distinct = cut.groupBy("seg").agg(F.first("terms").alias("terms"), F.first("template").alias("template"))
    every = distinct.select(F.explode("terms").alias("term")).distinct().join(F.broadcast(weights), "term", "left").fillna(rare, ["idf"])
    goal = spark.createDataFrame(
        [(i, re.findall(TERM, text.lower())) for i, (_, text) in enumerate(TEMPLATES + NOTICES)], "template int, terms array<string>"
    )
    goal = _vectors(goal, "template", weights)
    near = _vectors(distinct, "seg", every).join(distinct.select("seg", "template"), "seg")
    cosine = (
        near.alias("s").join(F.broadcast(goal).alias("t"), ["template", "term"]).groupBy("seg")
        .agg(F.round(F.sum(F.col("s.x") * F.col("t.x")), 9).alias("cosine"))
    )
    hits = cut.join(cosine.where(F.col("cosine") >= threshold), "seg")
    return hits.select("file", "line", "licence", "cosine")


def licence_tags(files: DataFrame) -> DataFrame:
    """``(file, line, licence, cosine)`` for the identifiers of SPDX tags.
    Exceptions (after ``WITH``) are no licences; ``-only``, ``-or-later`` and
    ``+`` are left out, and known identifiers take their usual case."""
    text = text_or_empty()
    lines = files.where(text.rlike(TAG)).select("file", F.posexplode(F.split(text, "\n", -1)).alias("line", "raw"))
    tags = lines.select("file", "line", F.explode(F.regexp_extract_all("raw", F.lit(TAG), 1)).alias("tag"))
    # An identifier stands first, or after an operator; words after the expression are none.
    expression = F.regexp_extract("tag", r"(?i)^[(\x20\t]*([a-z0-9.+:-]+(?:[)\x20\t]+(?:and|or|with)[(\x20\t]+[a-z0-9.+:-]+)*)", 1)
    bare = F.regexp_replace(expression, r"(?i)[)\x20\t]+with[\x20\t]+[a-z0-9.+:-]+", "")
    ids = F.split(bare, r"(?i)[()\x20\t]+(?:and|or)[()\x20\t]+")
    one = F.regexp_replace("id", r"(?i)(?:-only|-or-later|\+)?[.:-]*$", "")
    known = sorted({spdx for spdx, _ in TEMPLATES + NOTICES})
    usual = F.create_map(*[F.lit(x) for spdx in known for x in (spdx.lower(), spdx)])
    found = tags.select("file", "line", F.explode(ids).alias("id")).select("file", "line", one.alias("id"))
    found = found.where(~F.upper("id").isin("", "NONE", "NOASSERTION"))
    return found.select("file", "line", F.coalesce(usual[F.lower("id")], "id").alias("licence"), F.lit(1.0).alias("cosine"))


def scan_licences(files: DataFrame, path: Column, threshold: float = 0.6, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(path, licences, own, licence, cosine, from_dir)`` per row of
    ``files``, with the ``carry`` columns.

    ``licences`` lists the file's own licences in order; ``licence`` is the
    most similar of them, or the inherited one, with ``from_dir`` the
    directory it came from.
    """
    name = F.coalesce(path.cast("string"), F.lit(""))
    key = F.struct(name.alias("path"), F.xxhash64("text").alias("th"))
    keyed = files.select(key.alias("file"), "text")
    hits = licence_segments(keyed, threshold).unionByName(licence_windows(keyed, threshold)).unionByName(licence_tags(keyed))
    hits = stage(hits.distinct(), "hits")
    versioned = hits.select("file", F.regexp_extract("licence", r"^([AL]?GPL)-", 1).alias("licence")).where("licence <> ''").distinct()
    hits = hits.join(versioned, ["file", "licence"], "left_anti")
    # A line repeated in a file, or a repeated file, counts once.
    named = F.struct("cosine", (-F.col("line")).alias("order"), "licence")
    own = hits.groupBy("file").agg(
        F.array_sort(F.collect_set("licence")).alias("licences"), F.max(named).alias("best"), F.min("line").alias("first_line")
    )
    directory = F.regexp_replace("file.path", r"/?[^/]*$", "")
    rows = files.select(key.alias("file"), *carry)
    marked = stage(rows.join(own, "file", "left").withColumn("path", F.col("file.path")).withColumn("dir", directory), "marked")
    gives = F.col("best").isNotNull() & ((F.col("first_line") < HEADER_LINES) | F.col("path").rlike(LICENCE_FILE))
    given = F.max(F.struct(F.col("best.cosine").alias("cosine"), F.col("best.licence").alias("licence")))
    givers = marked.where(gives).groupBy("dir").agg(given.alias("given")).select(F.col("dir").alias("from_dir"), "given")

    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    dirs = marked.where("best is null").select("dir").distinct()
    chain = dirs.select("dir", F.posexplode(ancestors).alias("depth", "from_dir"))
    nearest = chain.join(givers, "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "given")).alias("near"))
    out = marked.join(nearest, "dir", "left")
    is_own = F.col("best").isNotNull()
    return out.select(
        *carry, "path", F.coalesce("licences", F.array().cast("array<string>")).alias("licences"), is_own.alias("own"),
        F.when(is_own, F.col("best.licence")).otherwise(F.col("near.given.licence")).alias("licence"),
        F.when(is_own, F.col("best.cosine")).otherwise(F.col("near.given.cosine")).alias("cosine"),
        F.when(~is_own, F.col("near.from_dir")).alias("from_dir"),
    )
