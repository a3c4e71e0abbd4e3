"""Licence scan: TF-IDF cosine of headers and licence files to licence templates, then nearest-ancestor inheritance.

DataFrame functions only. Templates are statements (a sentence or header paragraph each) and whole licence texts
(licence_texts/). A document is cut into units: its lines, its paragraphs (runs of lines with a term, so statements
wrapped over lines are one unit), its header (the leading comment) and the whole document. Statements are compared
with every unit, whole texts with headers and documents. Document frequencies are counted over all terms of all
documents, as partial aggregates.

By Cauchy's inequality a unit's cosine to a template is at most the norm of the template's unit vector over the terms
that the unit has. Units for which that bound is below `threshold` are dropped before all their terms are exploded,
which loses none. In the scan the largest weight that any template has at a term stands for all templates (looked up by
hash in an array literal of BOUND_BUCKETS entries, where colliding terms share the larger one); the units left then
meet the templates one by one, by their terms in the templates' vocabulary alone.

A document has the licence of its best unit. A statement licenses its document alone. A document is a licence file if as a
whole it reaches `threshold` against a whole licence text and does not begin with a comment, as source files with a header
do, or if its name says so (FILE_NAME) and it has a licence; its directory's documents, and those of directories below
without a nearer licence file, inherit.

Cases: null text counts as empty; null path is the root directory; ties go to the first licence by name, licence
files of a directory tie by score, then by path and licence; rows are told apart by id, path and text (nulls equal), and
repeated rows are reported each; an empty table gives an empty result.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, text_digest

# Public licence names and statements.
STATEMENTS = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "ISC": ["Licensed under the ISC License"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD License", "Licensed under the BSD 3-Clause License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved.", "Confidential and proprietary. All rights reserved."],
}
STOP = "a an and any are as by for form free from in is of or out source subject terms the this to use with without work".split()
#: A term never starts after one of .+- ; saying so keeps long runs of these linear.
TERM = r"(?<![.+-])[\p{L}\p{N}.+-]*[\p{L}\p{N}]"
#: How a line of a comment begins.
COMMENT = r"^\s*(?://|/\*|\*|#|--|;|%|<!--|\"\"\"|''')"
BOUND_BUCKETS = 65_536
#: Names of licence files, with or without an ending.
FILE_NAME = r"(?i)(?:^|/)(?:un)?(?:licen[cs]es?|copying|notice)(?:[.-][^/]*)?$"


def licence_texts(folder: Path | None = None) -> dict[str, str]:
    """Whole licence texts by name: the .txt files of a folder, by default those beside this module."""
    folder = folder or Path(__file__).parent / "licence_texts"
    return {f.stem: f.read_text(encoding="utf-8") for f in sorted(folder.glob("*.txt"))}


def terms(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0)), lambda x: ~x.isin(STOP))


def template_terms(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """licence, template, whole, term, tf: fixed and small."""
    rows = [(name, i, False, t) for name, ts in STATEMENTS.items() for i, t in enumerate(ts)]
    rows += [(name, -1, True, t) for name, t in (licence_texts() if texts is None else texts).items()]
    table = spark.createDataFrame(rows, "licence string, template int, whole boolean, text string")
    return table.select("licence", "template", "whole", F.explode(terms(F.col("text"))).alias("term")).groupBy("licence", "template", "whole", "term").agg(F.count(F.lit(1)).alias("tf"))


def _units(lines: str) -> Column:
    """array<struct<kind,at,terms>> of the units in lines, an array of struct<terms,comment> per line."""
    size = F.size(lines)
    full = lambda i: (i >= 0) & (i < size) & (F.size(F.get(lines, i)["terms"]) > 0)
    unit = lambda kind, at, t: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), t.alias("terms"))
    join = lambda a, n: F.flatten(F.transform(F.slice(lines, a + 1, n), lambda x: x["terms"]))
    index = F.sequence(F.lit(0), size - 1)
    firsts = F.filter(index, lambda i: full(i) & ~F.coalesce(full(i - 1), F.lit(False)))
    lasts = F.filter(index, lambda i: full(i) & ~F.coalesce(full(i + 1), F.lit(False)))
    runs = F.zip_with(firsts, lasts, lambda a, z: F.struct(a.alias("a"), z.alias("z")))
    # A paragraph of one line is that line; a document of one paragraph is that paragraph.
    runs = F.when(F.size(firsts) > 1, F.filter(runs, lambda r: r["z"] > r["a"])).otherwise(F.filter(runs, lambda r: F.lit(False)))
    each = F.transform(F.filter(index, full), lambda i: unit("line", i, F.get(lines, i)["terms"]))
    paragraphs = F.transform(runs, lambda r: unit("paragraph", r["a"], join(r["a"], r["z"] - r["a"] + 1)))
    code = F.filter(index, lambda i: full(i) & ~F.get(lines, i)["comment"])
    head = F.when(F.size(code) > 0, code[0]).otherwise(F.lit(0))
    header = F.filter(F.array(unit("header", F.lit(0), join(F.lit(0), head))), lambda u: head > 0)
    return F.concat(each, paragraphs, header, F.array(unit("document", F.lit(0), join(F.lit(0), size))))


def licence_units(docs: DataFrame, threshold: float = 0.7, texts: dict[str, str] | None = None) -> DataFrame:
    """row_id, kind, at (first line), licence, score, whole_score (against whole texts) of the units that state a licence; docs(row_id, t)."""
    spark = docs.sparkSession
    n = docs.count()
    df = docs.select(F.explode(F.array_distinct(terms(F.col("t")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = materialize(df, "licence-frequencies")
    idf = lambda c: F.log((F.lit(1.0 + n)) / (1.0 + c)) + 1.0
    templates = materialize(template_terms(spark, texts), "licence-templates")
    vocabulary = templates.select("term").distinct()
    known = templates.join(df.join(F.broadcast(vocabulary), "term"), "term", "left").withColumn("x", F.col("tf") * idf(F.coalesce("df", F.lit(0))))
    norms = known.groupBy("licence", "template").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    weights = materialize(known.join(norms, ["licence", "template"]).select("licence", "template", "whole", "term", (F.col("x") / F.col("norm")).alias("w")), "licence-weights")
    # Per bucket the largest squared weight that a template has at a term there: at most BOUND_BUCKETS rows of the fixed templates.
    bucket = lambda t: F.pmod(F.xxhash64(t), F.lit(BOUND_BUCKETS)).cast("int")
    peaks = {}
    for whole in (False, True):
        own = weights.filter(F.col("whole") == whole).groupBy(bucket(F.col("term")).alias("b")).agg(F.max(F.col("w") * F.col("w")).alias("m")).collect()
        peaks[whole] = [0.0] * BOUND_BUCKETS
        for r in own:
            peaks[whole][r["b"]] = r["m"] * (1 + 1e-9)
    literal = {k: F.from_json(F.lit("[" + ",".join(f"{x:.9g}" for x in v) + "]"), "array<double>") for k, v in peaks.items()}
    known_terms = [r[0] for r in vocabulary.collect()]  # of the fixed templates
    bound = lambda t, whole: F.aggregate(t, F.lit(0.0), lambda s, x: s + F.get(literal[whole], bucket(x)))
    least = threshold * threshold * (1 - 1e-6)
    reaches = lambda u: (bound(u["hits"], False) >= least) | (u["kind"].isin("header", "document") & (bound(u["hits"], True) >= least))
    with_hits = lambda u: F.struct(u["kind"].alias("kind"), u["at"].alias("at"), u["terms"].alias("terms"), F.array_distinct(F.filter(u["terms"], lambda x: x.isin(known_terms))).alias("hits"))
    lines = docs.select("row_id", F.transform(F.split("t", "\n"), lambda x: F.struct(terms(x).alias("terms"), F.rlike(x, F.lit(COMMENT)).alias("comment"))).alias("lines"))
    found = lines.select("row_id", F.explode(F.filter(F.transform(_units("lines"), with_hits), reaches)).alias("u")).select("row_id", "u.kind", "u.at", "u.terms", "u.hits")
    found = materialize(found, "licence-candidates")
    key = ["row_id", "kind", "at"]
    fits = ~F.col("whole") | F.col("kind").isin("header", "document")
    covered = found.select(*key, F.explode("hits").alias("term")).join(F.broadcast(weights), "term").filter(fits)
    covered = covered.groupBy(*key, "licence", "template").agg(F.sum(F.col("w") * F.col("w")).alias("c")).filter(F.col("c") >= least)
    covered = materialize(covered.select(*key).distinct(), "licence-covered")
    found = found.join(broadcast_if_small(covered, covered.count(), 200_000), key, "left_semi")
    own = found.select(*key, F.explode("terms").alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))
    asked = materialize(own.join(df, "term").select(*key, "term", (F.col("tf") * idf(F.col("df"))).alias("v")), "licence-terms")
    norm = asked.groupBy(*key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dots = asked.join(F.broadcast(weights), "term").filter(fits).groupBy(*key, "licence", "template", "whole").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    scored = dots.join(norm, key).withColumn("score", F.col("dot") / F.col("norm")).filter(F.col("score") >= threshold)
    return scored.groupBy(*key).agg(
        F.min_by("licence", F.struct(-F.round("score", 9), F.col("licence"))).alias("licence"), F.max("score").alias("score"), F.max(F.when(F.col("whole"), F.col("score"))).alias("whole_score"),
    )


def licence_scan(docs: DataFrame, path: Column, threshold: float = 0.7, texts: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, path, own_licence, own_score, licence_file, licence, inherited_from.

    The licence is the document's own, else the nearest ancestor directory's.
    """
    where = F.coalesce(path, F.lit(""))
    row = F.struct(F.col(id_col).alias("doc_id"), where.alias("path"), text_digest(F.col(text_col)).alias("digest"))
    base = docs.select(row.alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))  # repeated rows scale their terms, which leaves cosines
    found = materialize(licence_units(base, threshold, texts), "licence-units")
    own = found.groupBy("row_id").agg(
        F.max("score").alias("own_score"), F.min_by("licence", F.struct(-F.round("score", 9), F.col("licence"))).alias("own_licence"),
        F.max(F.when(F.col("kind") == "document", F.col("whole_score"))).alias("file_score"),
    )
    directory = F.regexp_extract("row_id.path", r"^(.*)/[^/]*$", 1)
    plain = ~F.rlike(F.regexp_replace("t", r"^\s+", ""), F.lit(COMMENT))
    rows = base.select("row_id", directory.alias("dir"), plain.alias("plain")).join(broadcast_if_small(own, found.count(), 200_000), "row_id", "left")
    named = F.rlike("row_id.path", F.lit(FILE_NAME)) & F.col("own_licence").isNotNull()
    file_ = F.coalesce(named | (F.col("plain") & F.col("file_score").isNotNull()), F.lit(False))
    file_score = F.coalesce("file_score", "own_score")
    rows = materialize(rows.select("row_id", "dir", "own_licence", "own_score", file_score.alias("file_score"), file_.alias("licence_file")), "licence-rows")
    given = rows.filter("licence_file").groupBy("dir").agg(F.min_by("own_licence", F.struct(-F.round("file_score", 9), F.col("row_id.path"), F.col("own_licence"))).alias("given"))
    given = materialize(given.withColumnRenamed("dir", "up"), "licence-given")
    # Directories, not documents, are joined with their ancestors.
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    dirs = rows.select("dir").distinct().withColumn("up", F.explode(F.array_distinct(F.concat(above, F.array(F.lit(""))))))
    nearest = dirs.join(broadcast_if_small(given, given.count(), 200_000), "up").groupBy("dir").agg(F.max_by("given", F.length("up")).alias("given"), F.max_by("up", F.length("up")).alias("from"))
    nearest = materialize(nearest, "licence-dirs")
    out = rows.join(broadcast_if_small(nearest, nearest.count(), 100_000), "dir", "left")
    return out.select(
        "row_id.doc_id", "row_id.path", "own_licence", "own_score", "licence_file", F.coalesce("own_licence", "given").alias("licence"),
        F.when(F.col("own_licence").isNull(), F.col("from")).alias("inherited_from"),
    )
