"""Licence scans: TF-IDF cosine to licence statements, then inheritance from the nearest directory with a licence file.

The document frequencies of all terms are counted once over all documents; a term weighs its count times
log((1 + N) / (1 + df)) + 1. Norms count every term of a part. The anchors of a statement of TEMPLATES are its heaviest terms, enough of them that all
other terms together cannot reach MIN_COSINE. Around each anchor of a text, windows as long as the statement, laid so that
the anchor stands where it stands there, become term counts, however lines are cut; lines with an anchor and runs of
HEADER_LINES lines do too. A join with the statements' weights sums their cosines. Only such parts leave their row.

A text whose cosine to a whole licence text (BODIES) reaches MIN_COSINE is a licence file of that licence; so is one whose
words nearly all belong to a statement. Texts with too few rare terms of every licence text are left out, again exactly. A
document without a licence of its own takes the one of the nearest directory at or above its own that holds a licence file,
found by joining directories, not rows.

Equal texts share their cosines. Defined results: null and empty texts have no licence; a null path inherits nothing; on
equal cosines the first licence name wins, also between licence files of one directory; repeated rows stay; an empty table
gives no rows; columns named like results are replaced. A long text is cut at its anchors: one that is full of them unfolds into
windows of up to twice the longest notice each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from importlib.resources import files
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadspark.llm.common import clean_text
from loadspark.llm.registry import query, table
from loadspark.session import materialise

#: Licence identifiers and sentences of their notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License, "
                "or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights"),
)
MIN_COSINE = 0.8
HEADER_LINES = 4
#: A statement alone is a licence file: this share of its words are terms of the statement it is closest to.
FILE_SHARE = 0.9
#: Terms that name a licence: a part is only close to a statement if it has all of these that the statement has.
NAMES = frozenset("apache mit gnu lesser affero mozilla 2 3 2.0 by by-sa by-nc".split())
TERM = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"
DIGITS = 6
#: Words by which titles of one family differ, looked for in the first terms: a licence file has those of its licence text.
TITLE = "affero|lesser|library|noncommercial|sharealike|noderiv"
TITLE_TERMS = 40


def terms_of(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def _notices(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    """Statements and the one-line tags of their licences, as terms."""
    tags = sorted({(name, f"SPDX-License-Identifier: {name}") for name, _ in templates})
    return [(name, terms_of(text)) for name, text in [*templates, *tags]]


NOTICES = _notices()
#: Terms of NAMES and identifiers in tags, by notice.
NAMED = [{t for t in terms if t in NAMES or (t == name.lower() and len(terms) == 2)} for name, terms in NOTICES]
TERMS = sorted({t for _, terms in NOTICES for t in terms})


def _bodies() -> list[tuple[str, list[str]]]:
    """Whole licence texts, without their copyright lines, as terms."""
    texts = sorted((f for f in files("loadspark.llm").joinpath("licences").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return [(f.name.removesuffix(".txt"), terms_of(f.read_text("utf-8"))) for f in texts]


BODIES = _bodies()
BODY_TERMS = sorted({t for _, terms in BODIES for t in terms})


def text_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """term, df: in how many rows a term occurs."""
    found = df.select(F.explode(F.array_distinct(text_terms(clean_text(text)))).alias("term"))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_weights(
    df: DataFrame, text: str = "text", terms: list[str] = TERMS, counted: DataFrame | None = None, rows: int | None = None
) -> dict[str, float]:
    """Inverse document frequency of the given terms over all rows; as many numbers as there are terms."""
    counted = vocabulary(df, text) if counted is None else counted
    counts = {r["term"]: r["df"] for r in counted.where(F.col("term").isin(terms)).collect()}
    rows = df.count() if rows is None else rows
    return {t: round(math.log((1 + rows) / (1 + counts.get(t, 0))) + 1, DIGITS) for t in terms}


def anchors(weights: dict[str, float]) -> list[str]:
    """Terms of which a text needs at least one to reach MIN_COSINE with any notice."""
    need: set[str] = set()
    for _, terms in NOTICES:
        parts = sorted((((c * weights[t]) ** 2, t) for t, c in Counter(terms).items()), reverse=True)
        rest = sum(p for p, _ in parts)
        bound = MIN_COSINE**2 * rest * (1 - 1e-6)
        for part, t in parts:
            if rest < bound:
                break
            need.add(t)
            rest -= part
    return sorted(need)


def anchor_pattern(weights: dict[str, float]) -> str:
    """Finds an anchor that stands alone, as every term does."""
    return f"(?<![a-z0-9])(?:{'|'.join(map(re.escape, anchors(weights)))})(?![a-z0-9])"


def rare_terms(weights: dict[str, float]) -> list[tuple[list[str], int]]:
    """Rare terms of each licence text, and how many of them a text needs at least to reach MIN_COSINE with it."""
    out = []
    for _, terms in BODIES:
        parts = sorted(((weights[t], (c * weights[t]) ** 2, t) for t, c in Counter(terms).items()), reverse=True)
        rest = sum(p for _, p, _ in parts)
        bound = MIN_COSINE**2 * rest * (1 - 1e-6)
        rare: list[tuple[float, str]] = []
        for _, part, t in parts:
            if rest < bound / 2:
                break
            rare.append((part, t))
            rest -= part
        need = 0
        for part, _ in sorted(rare, reverse=True):
            if rest >= bound:
                break
            rest += part
            need += 1
        out.append((sorted(t for _, t in rare), need))
    return out


def _weight_rows(notices: list[tuple[str, list[str]]], weights: dict[str, float], named: list[set[str]]) -> list[tuple]:
    """notice, license, term, weight (unit length), names (1 for a naming term), all_names: one row per term of a notice."""
    rows = []
    for k, (name, terms) in enumerate(notices):
        raw = {t: c * weights[t] for t, c in Counter(terms).items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        rows += [(k, name, t, v / norm, int(t in named[k]), len(named[k])) for t, v in sorted(raw.items())]
    return rows


def _cosines(
    parts: DataFrame, notices: list[tuple[str, list[str]]], weights: dict[str, float], counted: DataFrame, rows: int,
    named: list[set[str]] | None = None,
) -> DataFrame:
    """key, license, cosine, shared (words that are terms of the notice) from MIN_COSINE on; `parts` has key, terms.

    The norm over the notices' terms alone is never above the whole one. Only parts that pass with it need the document
    frequencies of their other terms. `parts` is read twice. `named` has terms that a part must share, by notice.
    """
    spark = parts.sparkSession
    known = sorted({t for _, terms in notices for t in terms})
    idf = F.broadcast(spark.createDataFrame([(t, weights[t]) for t in known], "term string, idf double"))
    unit = _weight_rows(notices, weights, named or [set()] * len(notices))
    unit = F.broadcast(spark.createDataFrame(unit, "notice int, license string, term string, weight double, names int, all_names int"))
    square = F.sum(F.col("value") * F.col("value"))
    tf = parts.select("key", F.explode(F.filter("terms", lambda t: t.isin(known))).alias("term"))
    tf = tf.groupBy("key", "term").agg(F.count(F.lit(1)).alias("n"))
    tf = materialise(tf.join(idf, "term").select("*", (F.col("n") * F.col("idf")).alias("value")))
    known_norms = tf.groupBy("key").agg(F.sqrt(square).alias("known_norm"))
    dots = tf.join(unit, "term").groupBy("key", "notice", "license", "all_names").agg(
        F.sum(F.col("value") * F.col("weight")).alias("dot"), F.sum("n").alias("shared"), F.sum("names").alias("names")
    ).where(F.col("names") == F.col("all_names"))
    near = materialise(dots.join(known_norms, "key").where(F.col("dot") >= (MIN_COSINE - 10.0**-DIGITS) * F.col("known_norm")))
    words = parts.join(near.select("key").distinct(), "key").select("key", F.explode("terms").alias("term"))
    words = words.groupBy("key", "term").agg(F.count(F.lit(1)).alias("n"))
    weight = F.round(F.log((1.0 + rows) / (1 + F.col("df"))) + 1, DIGITS)
    norms = words.join(counted, "term").select("key", (F.col("n") * weight).alias("value")).groupBy("key").agg(F.sqrt(square).alias("norm"))
    return near.join(norms, "key").select(
        "key", "license", F.round(F.col("dot") / F.col("norm"), DIGITS).alias("cosine"), "shared"
    ).where(F.col("cosine") >= MIN_COSINE)


def _segments(text: Column, anchor: str) -> Column:
    """(number, line) of lines with an anchor, wrapped runs that begin there, and the whole text."""
    lines = F.split(text, "\n", -1)
    runs = F.zip_with(
        lines,
        F.transform(
            F.arrays_zip(*(F.slice(lines, 1 + k, F.size(lines)).alias(f"l{k}") for k in range(HEADER_LINES))),
            lambda x: F.concat_ws(" ", *(x[f"l{k}"] for k in range(HEADER_LINES))),
        ),
        lambda line, run: F.struct(line.alias("line"), run.alias("run")),
    )
    hit = F.filter(runs, lambda r: F.lower(r["run"]).rlike(anchor))
    return F.concat(F.flatten(F.transform(hit, lambda r: F.array(r["line"], r["run"]))), F.array(text))


def places(weights: dict[str, float]) -> list[tuple[str, int, int]]:
    """term, length, place: where anchors stand in the statements, and how many terms those have."""
    heavy = set(anchors(weights))
    return sorted({(t, len(terms), k) for _, terms in NOTICES for k, t in enumerate(terms) if t in heavy})


def _windows(hit: DataFrame, weights: dict[str, float]) -> DataFrame:
    """__digest, terms: for each anchor, as many terms as each of its statements has, where the statement would lie."""
    heavy, spots = anchors(weights), places(weights)
    most = max(length for _, length, _ in spots)
    numbered = F.transform("terms", lambda t, k: F.struct(t.alias("term"), k.alias("at")))
    found = F.filter(numbered, lambda x: x["term"].isin(heavy))
    # An anchor leaves its row with the terms around it, never with the whole text.
    around = F.transform(
        found,
        lambda x: F.struct(
            x["term"].alias("term"),
            F.least(x["at"], F.lit(most)).alias("before"),
            F.slice(F.col("terms"), F.greatest(x["at"] - most, F.lit(0)) + 1, F.lit(2 * most)).alias("near"),
        ),
    )
    spots = F.broadcast(hit.sparkSession.createDataFrame(spots, "term string, length int, place int"))
    cut = hit.select("__digest", F.explode(F.array_distinct(around)).alias("a")).select("__digest", "a.*").join(spots, "term")
    start = F.col("before") - F.col("place")
    length = F.col("length") + F.least(start, F.lit(0))
    return cut.select("__digest", F.slice("near", F.greatest(start, F.lit(0)) + 1, length).alias("terms"))


def own_licences(marked: DataFrame, weights: dict[str, float], counted: DataFrame, rows: int, text: str = "text") -> DataFrame:
    """Best statement and cosine per text, and whether the text is nothing else; `marked` has text, __digest, __hit."""
    hit = marked.where("__hit").dropDuplicates(["__digest"])
    segments = hit.select("__digest", F.explode(_segments(F.col(text), anchor_pattern(weights))).alias("part"), F.length(text).alias("length"))
    segments = segments.select("__digest", text_terms(F.col("part")).alias("terms"), (F.length("part") == F.col("length")).alias("whole"))
    windows = _windows(hit.select("__digest", text_terms(F.col(text)).alias("terms")), weights)
    segments = segments.unionByName(windows.withColumn("whole", F.lit(False)))
    # Equal parts are compared once; the whole text alone decides about licence files.
    segments = materialise(segments.withColumn("key", F.md5(F.concat_ws(" ", "terms").cast("binary"))))
    parts = materialise(segments.select("key", "terms").dropDuplicates(["key"]))
    near = materialise(_cosines(parts, NOTICES, weights, counted, rows, NAMED))
    uses = segments.groupBy("__digest", "key").agg(F.max("whole").alias("whole"), F.max(F.size("terms")).alias("words"))
    scored = uses.join(near, "key").withColumn("file", F.col("whole") & (F.col("shared") >= FILE_SHARE * F.col("words")))
    best = scored.groupBy("__digest", "license").agg(F.max("cosine").alias("cosine"), F.max("file").alias("file"))
    first = F.min(F.struct((-F.col("cosine")).alias("c"), "license", "file"))
    return best.groupBy("__digest").agg(first.alias("b")).select(
        "__digest", F.col("b.license").alias("own_license"), (-F.col("b.c")).alias("cosine"), F.col("b.file").alias("file")
    )


def _title(terms: Column) -> Column:
    """The words of TITLE in the first terms of a text, one space between them."""
    found = F.regexp_extract_all(F.array_join(F.slice(terms, 1, TITLE_TERMS), " "), F.lit(f"({TITLE})"), F.lit(1))
    return F.array_join(F.array_sort(F.array_distinct(found)), " ")


def file_licences(marked: DataFrame, weights: dict[str, float], counted: DataFrame, rows: int, text: str = "text") -> DataFrame:
    """Closest whole licence text and cosine of every text that is one; `marked` has text, __digest, __body."""
    parts = marked.where("__body").dropDuplicates(["__digest"]).select(F.col("__digest").alias("key"), text_terms(F.col(text)).alias("terms"))
    parts = materialise(parts.withColumn("title", _title(F.col("terms"))))
    titles = [(name, " ".join(sorted(set(re.findall(TITLE, " ".join(terms[:TITLE_TERMS])))))) for name, terms in BODIES]
    titles = F.broadcast(marked.sparkSession.createDataFrame(titles, "license string, title string"))
    near = _cosines(parts.select("key", "terms"), BODIES, weights, counted, rows)
    near = near.join(parts.select("key", "title"), "key").join(titles, ["license", "title"])
    first = F.min(F.struct((-F.col("cosine")).alias("c"), "license"))
    return near.groupBy("key").agg(first.alias("b")).select(
        F.col("key").alias("__digest"), F.col("b.license").alias("own_license"), (-F.col("b.c")).alias("cosine"), F.lit(True).alias("file")
    )


def parent(path: Column) -> Column:
    """The directory of a path, '' at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


#: Columns that a scan adds; columns of these names are replaced.
MADE = ("own_license", "cosine", "inherited_license", "license")
#: Groups that the rows of one directory are spread over when they meet its licence.
SPREAD = 32


def scan_licences(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns, own_license, cosine, inherited_license (only without one's own), license."""
    kept = [c for c in (df.columns if keep is None else keep)]
    counted, total = materialise(vocabulary(df, text)), df.count()
    weights = term_weights(df, text, TERMS, counted, total)
    body_weights = term_weights(df, text, BODY_TERMS, counted, total)
    heavy, rare = anchors(weights), rare_terms(body_weights)
    least = min(need for _, need in rare)
    wanted = sorted({*heavy, *(t for terms, _ in rare for t in terms)})
    t = clean_text(text)
    marked = df.select(
        *(F.col(f"`{c}`").alias(f"k_{c}") for c in kept),
        parent(F.col(path)).alias("__dir"),
        t.alias(text),
        F.filter(F.array_distinct(text_terms(t)), lambda x: x.isin(wanted)).alias("__found"),
    )
    body = reduce(or_, (F.size(F.array_intersect("__found", F.array(*map(F.lit, terms)))) >= need for terms, need in rare))
    marked = marked.withColumns({
        "__hit": F.exists("__found", lambda x: x.isin(heavy)),
        "__body": F.when(F.size("__found") >= least, body).otherwise(False),
    }).drop("__found")
    # Only texts that are looked at closely are stored.
    close = F.col("__hit") | F.col("__body")
    marked = marked.withColumns({
        "__digest": F.when(close, F.md5(F.col(text).cast("binary"))), text: F.when(close, F.col(text)),
    })
    marked = materialise(marked)
    said = own_licences(marked, weights, counted, total, text).withColumn("rank", F.lit(1))
    whole = file_licences(marked, body_weights, counted, total, text).withColumn("rank", F.lit(0))
    # What a licence file says about itself counts more than statements inside it.
    best = F.min_by(F.struct("own_license", "cosine", "file"), "rank")
    own = materialise(whole.unionByName(said).groupBy("__digest").agg(best.alias("b")).select("__digest", "b.*"))
    rows = marked.drop(text)
    names = [f"k_{c}" for c in kept]
    hits = rows.where("__digest IS NOT NULL").join(own, "__digest", "left").select(*names, "__dir", "own_license", "cosine", "file")
    plain = rows.where("__digest IS NULL").select(
        *names, "__dir", F.lit(None).cast("string").alias("own_license"), F.lit(None).cast("double").alias("cosine"),
        F.lit(False).alias("file"),
    )
    all_rows = materialise(plain.unionByName(hits))
    given = (
        all_rows.where("file AND __dir IS NOT NULL")
        .groupBy(F.col("__dir").alias("above"))
        .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "own_license")).alias("g"))
        .select("above", F.col("g.own_license").alias("given"))
    )
    dirs = all_rows.where("__dir IS NOT NULL").select("__dir").distinct()
    parts = F.split("__dir", "/", -1)
    ladder = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    steps = dirs.select("__dir", F.posexplode(F.array_union(F.array(F.lit("")), ladder)).alias("depth", "above"))
    nearest = steps.join(given, "above").groupBy(F.col("__dir").alias("dir")).agg(
        F.max(F.struct("depth", "given")).alias("n")
    ).select("dir", F.col("n.given").alias("given"))
    # A directory may hold a third of all rows: they meet its licence in SPREAD groups.
    nearest = nearest.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    slot = F.pmod(F.xxhash64(*(c for c in all_rows.columns if c != "__dir")), F.lit(SPREAD)).cast("int")
    joined = all_rows.withColumn("__slot", slot).join(
        nearest, (F.col("__dir") == F.col("dir")) & (F.col("__slot") == F.col("at")), "left"
    )
    inherited = F.when(F.col("own_license").isNull(), F.col("given"))
    return joined.select(
        *(F.col(f"k_{c}").alias(c) for c in kept if c not in MADE),
        "own_license",
        "cosine",
        inherited.alias("inherited_license"),
        F.coalesce("own_license", inherited).alias("license"),
    )


@query("op6_license_scan")
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document; a document is the file source/doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    docs = docs.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    return scan_licences(docs, "path", keep=["doc_id"])
