"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

A file's passages are single lines and blocks of lines without a blank one between, anywhere in the file, each scored
apart. A line or block is a passage if it shares a pair of neighbouring words of five letters or more with some
template (`anchors`); a licence file (LICENSE, COPYING or NOTICE) has its whole text as a passage too. The best
passage counts. Passages and templates are bags of words. A word's weight is its count times the inverse document
frequency, counted by Spark over all distinct passages and the templates; the cosine is the sum over the words that a
passage shares with a template (one equi-join on the word) over the two norms. The best template at or above
`min_cosine` is the file's own licence. A file without one takes that of its nearest ancestor directory which holds
a licence file, found by joining the file's ancestor paths to the directories.

Defined cases: null text has no passages; a null path has no directory; ties go by template name; several licence
files of a directory give it their best match, ties by path; repeated rows each give their row; equal passages are
matched once; texts are whole, however long; columns of `files` may have any name (those of the result are replaced).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismfold.llm.shared import broadcast_if_small, free_names, materialize

#: Statements, standard headers and opening texts of licences (fixed values); a caller may pass others.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
    ),
}
_FILES = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice)(?:\.[^/]*)?$"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9.-]*[a-z0-9]|[a-z0-9]"), F.lit(0))


def anchors(templates: dict[str, tuple[str, ...]]) -> str:
    """The pattern of all pairs of neighbouring words of five letters or more in the templates."""
    pairs = set()
    for text in (t for many in templates.values() for t in many):
        words = re.findall(r"[a-z0-9]+", text.lower())
        pairs |= {(a, b) for a, b in zip(words, words[1:]) if min(len(a), len(b)) > 4 and (a + b).isalpha()}
    return r"(?i)\b(?:" + "|".join(rf"{a}[^\p{{L}}\p{{N}}]+{b}" for a, b in sorted(pairs)) + r")\b"


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _ancestors(directory: Column) -> Column:
    """The directory and all above it, the root as ''."""
    parts = F.split(directory, "/")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def _weighted(bags: DataFrame, idf: DataFrame) -> DataFrame:
    """key, word, weight and the norm of each bag; `idf` is broadcast only if small."""
    terms = bags.select("key", F.explode("words").alias("word")).groupBy("key", "word").agg(F.count("*").alias("n"))
    return terms.join(idf, "word").select("key", "word", (F.col("n") * F.col("idf")).alias("weight"))


def match_templates(passages: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """key, license and cosine of the best template of each passage (key, text); keys are distinct."""
    spark = passages.sparkSession
    listed = [(f"{i} {name}", name, text) for name in sorted(templates) for i, text in enumerate(templates[name])]
    known = spark.createDataFrame(listed, "key string, license string, text string").select("key", _words(F.col("text")).alias("words"))
    bags = materialize(passages.select("key", _words(F.col("text")).alias("words")), "license-bags")
    every = bags.select(F.array_distinct("words").alias("words")).unionByName(known.select(F.array_distinct("words").alias("words")))
    total = bags.count() + len(listed)
    idf = every.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")).select("word", (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1).alias("idf"))
    idf = materialize(idf, "license-idf")
    small = broadcast_if_small(idf, "word")
    left = _weighted(bags, small)
    norms = left.groupBy("key").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    right = materialize(_weighted(known, small).withColumnsRenamed({"key": "template", "weight": "other"}), "license-templates")
    right_norms = right.groupBy("template").agg(F.sqrt(F.sum(F.col("other") * F.col("other"))).alias("other_norm"))
    dots = left.join(broadcast_if_small(right, 64), "word").groupBy("key", "template").agg(F.sum(F.col("weight") * F.col("other")).alias("dot"))
    cosines = dots.join(norms, "key").join(broadcast_if_small(materialize(right_norms, "license-norms"), 48), "template")
    license = F.expr("substring(template, instr(template, ' ') + 1)").alias("license")
    cosines = cosines.select("key", license, F.round(F.col("dot") / F.col("norm") / F.col("other_norm"), 6).alias("cosine"))
    best = cosines.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    return best.select("key", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def _passages(text: Column, whole: Column, pattern: str) -> Column:
    """array<string>: the lines and blocks of a text that hold an anchor, and the whole text where `whole` is true."""
    hold = lambda piece: piece.rlike(pattern)
    lines, blocks = (F.filter(F.split(text, cut), hold) for cut in ("\n", r"\n[\x20\t\r]*\n\s*"))
    found = F.when(text.rlike(pattern), F.concat(lines, blocks)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(found, F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>"))))


def scan_licenses(files: DataFrame, *, path_col: str, text_col: str, templates: dict[str, tuple[str, ...]] = TEMPLATES, min_cosine: float = 0.5) -> DataFrame:
    """The rows and columns of `files` less the text, and own_license, cosine, license and origin ("file", "directory"
    or null)."""
    made = ("own_license", "cosine", "license", "origin")
    carried = [c for c in files.columns if c != text_col and c not in made]
    row, is_file, found, directory, inherited, best = free_names([*files.columns, *made], "row", "is_file", "passages", "directory", "inherited", "best")
    path = F.col(f"`{path_col}`")
    whole = F.coalesce(path.rlike(_FILES), F.lit(False))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    told = files.select(*[F.col(f"`{c}`") for c in carried], whole.alias(is_file), _passages(text, whole, anchors(templates)).alias(found), F.monotonically_increasing_id().alias(row))
    told = materialize(told, "license-files")
    # equal passages are matched once: repeated headers cost nothing more
    held = told.select(F.col(row).alias("row"), F.explode(found).alias("text")).filter("text <> ''")
    held = materialize(held.select("row", F.md5("text").alias("key"), "text"), "license-passages")
    matched = materialize(match_templates(held.groupBy("key").agg(F.min("text").alias("text")), templates).filter(F.col("cosine") >= min_cosine), "license-matched")
    own = held.select("row", "key").join(broadcast_if_small(matched, 80), "key")
    own = own.groupBy("row").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("best"))
    own = broadcast_if_small(materialize(own, "license-own"), 64)
    told = told.drop(found).join(own.withColumnsRenamed({"row": row, "best": best}), row, "left").drop(row).withColumn(directory, _directory(path))
    license = F.col(f"{best}.license")
    sources = told.filter(F.col(is_file) & license.isNotNull()).select(F.col(directory).alias("directory"), path.alias("path"), F.col(f"{best}.c").alias("c"), license.alias("license"))
    sources = sources.groupBy("directory").agg(F.min(F.struct("c", "path", "license")).alias("b"))
    sources = materialize(sources.select("directory", F.col("b.license").alias("inherited")), "license-directories")
    places = materialize(told.filter(license.isNull() & path.isNotNull()).select(F.col(directory).alias("directory")).distinct(), "license-places")
    up = places.select("directory", F.posexplode(_ancestors(F.col("directory"))).alias("depth", "ancestor"))
    nearest = up.join(broadcast_if_small(sources, "directory").withColumnRenamed("directory", "ancestor"), "ancestor")
    nearest = materialize(nearest.groupBy("directory").agg(F.max_by("inherited", "depth").alias("inherited")), "license-nearest")
    out = told.join(broadcast_if_small(nearest, "directory").withColumnsRenamed({"directory": directory, "inherited": inherited}), directory, "left")
    return out.select(
        *[F.col(f"`{c}`") for c in carried],
        license.alias("own_license"),
        (-F.col(f"{best}.c")).alias("cosine"),
        F.coalesce(license, F.col(inherited)).alias("license"),
        F.when(license.isNotNull(), "file").when(F.col(inherited).isNotNull(), "directory").alias("origin"),
    )
