"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory above.

With DataFrame functions only. A header is a line of the whole text in which at least one distinct term in DENSITY is a content
term of the templates (function words and numbers are none), two in all, or one in a line of up to SHORT_LINE terms; so no cue
word decides. Distinct headers are counted over all documents, weighted by TF-IDF (document frequencies over all headers of the
corpus) and compared with the templates by sparse dot products. A document's licence is the best one of its headers at THRESHOLD
or more. Documents that mostly are headers, or are named like licence files, are compared as a whole as well, with the texts of
whole licences, however their lines are wrapped. If such a document has a licence it is a licence file: its directory's licence
(the most frequent, ties in order of name) goes to the documents below it that have none, from the nearest such directory.

Terms that no template has are weighted by their own frequencies as well. The terms of the templates are a fixed, small
set, and their frequencies are broadcast; those of all terms, lines and documents are joined by shuffling, unless counted
small.

Defined results: null and empty texts have no header; a null directory is the root; repeated rows are judged alike;
without any header every licence is null; an empty table gives an empty result; extra columns are passed over.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwright.llm.common import cut

THRESHOLD = 0.5
DENSITY, SHORT_LINE = 10, 3
#: A document with at least this share of its words in headers is compared as a whole.
FILE_SHARE = 0.5
FILE_NAMES = r"(?i)^(un)?licen[sc]e|^copying|^notice"
BROADCAST_LINES = 100_000
WORD = r"[^ \t\n\x0B\f\r]+"

#: Usual short notices and opening sentences of public licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0, the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("proprietary", "All rights reserved."),
)

#: The texts of whole licences.
FILES = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
)

#: Words of the templates that say nothing of licences.
FUNCTION_WORDS = set(
    "a above all an and any anyone are as at be but by do either following for from general if in including into is it limited list may met must name names neither no non nor not of on or other otherwise out part "
    "prior provided shall so subject that the their this to under use used v version whether whom with without work"
    .split()
)
CONTENT = tuple(sorted({w for _, text in (*TEMPLATES, *FILES) for w in re.findall("[a-z]{2,}", text.lower())} - FUNCTION_WORDS))


def terms_of(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), r"[^a-z0-9]+"), "")


def is_header(terms: Column) -> Column:
    known, n = F.size(F.array_intersect(terms, F.array(*map(F.lit, CONTENT)))), F.size(F.array_distinct(terms))
    return ((known >= 2) | ((known == 1) & (n <= SHORT_LINE))) & (DENSITY * known >= n)


def headers_of(text: Column) -> Column:
    """The headers of a text, with repeats."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("x"), terms_of(x).alias("t")))
    return F.transform(F.filter(lines, lambda s: is_header(s["t"])), lambda s: s["x"])


def spread_terms(df: DataFrame, text: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.explode(terms_of(F.col(text))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def frequencies(lines: DataFrame) -> tuple[DataFrame, int]:
    """((term, df), number of headers); lines: distinct headers with n, their number in the corpus."""
    total = int(lines.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    return cut(spread_terms(lines, "line", "line", "n").groupBy("term").agg(F.sum("n").alias("df")), "frequencies"), total


def best_templates(spread: DataFrame, key: str, known: tuple[DataFrame, int], texts: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(key, licence, similarity) of the template that is nearest, of equal ones the first. spread: key, term, tf; known: frequencies."""
    df, total = known
    of_terms = F.broadcast(df) if df.count() <= BROADCAST_LINES else df
    weight = F.log((1.0 + F.lit(total)) / (1.0 + F.coalesce(F.col("df"), F.lit(1)))) + 1.0
    templates = spread.sparkSession.createDataFrame([(k, name, text) for k, (name, text) in enumerate(texts)], "template int, licence string, text string")
    t_terms = spread_terms(templates, "text", "template")
    idf = cut(t_terms.select("term").distinct().join(df, "term", "left").select("term", weight.alias("idf")), "idf")
    w = spread.join(of_terms, "term", "left").select(key, "term", (F.col("tf") * weight).alias("w"))
    norms = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    t = t_terms.join(F.broadcast(idf), "term").select("template", "term", (F.col("tf") * F.col("idf")).alias("tw"))
    t_norm = t.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("t_norm"))
    dots = w.join(F.broadcast(t), "term").groupBy(key, "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms, key).join(F.broadcast(t_norm), "template").join(F.broadcast(templates.select("template", "licence")), "template")
    best = F.max(F.struct(F.round(F.col("dot") / F.col("norm") / F.col("t_norm"), 6).alias("similarity"), (-F.col("template")).alias("order"), F.col("licence"))).alias("b")
    return scored.groupBy(key).agg(best).select(key, "b.licence", "b.similarity")


def licence_of_lines(lines: DataFrame) -> DataFrame:
    """(line, licence, similarity) of the best template; lines: distinct headers with n, their number in the corpus."""
    return best_templates(spread_terms(lines, "line", "line"), "line", frequencies(lines))


def ancestors(directory: Column) -> Column:
    """(path, depth) of a directory and all above it, to the root, ''."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("path"), k.alias("depth")))


def tidy(directory: Column) -> Column:
    return F.array_join(F.filter(F.split(F.coalesce(directory, F.lit("")), "/"), lambda x: x != ""), "/")


def scan(docs: DataFrame, directory: Column, name: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, directory, own_licence, similarity, is_file, licence and licence_from (the directory, '.' for the document itself)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), tidy(directory).alias("directory"), F.coalesce(name, F.lit("")).alias("name"), text.alias("text"), headers_of(text).alias("headers"))
    some = F.size("headers") > 0
    words = F.when(some, F.regexp_count("text", F.lit(WORD))).otherwise(0)
    in_headers = F.aggregate("headers", F.lit(0), lambda n, x: n + F.regexp_count(x, F.lit(WORD)))
    rows = rows.select("id", "directory", "name", "headers", F.when(some & (F.col("name").rlike(FILE_NAMES) | (in_headers >= FILE_SHARE * words)), F.col("text")).alias("whole"))
    rows = cut(rows.withColumn("row", F.when(some, F.concat_ws("-", F.monotonically_increasing_id(), F.xxhash64("id", "headers")))), "headers")
    marked = rows.where("row is not null")
    lines = cut(marked.select(F.explode("headers").alias("line")).groupBy("line").agg(F.count("*").alias("n")), "lines")
    counts = frequencies(lines)
    known = cut(best_templates(spread_terms(lines, "line", "line"), "line", counts).where(F.col("similarity") >= threshold), "licences")
    counted = F.broadcast(known) if known.count() <= BROADCAST_LINES else known
    of_lines = marked.select("row", F.explode("headers").alias("line")).join(counted, "line").select("row", "licence", "similarity")
    files = marked.where("whole is not null").select("row", "whole")
    of_files = best_templates(spread_terms(files, "whole", "row"), "row", counts, FILES).where(F.col("similarity") >= threshold)
    best = F.max(F.struct(F.col("similarity"), F.col("licence"))).alias("b")
    own = of_lines.unionAll(of_files.select("row", "licence", "similarity")).groupBy("row").agg(best).select(F.col("row").alias("of"), F.col("b.licence").alias("own_licence"), F.col("b.similarity").alias("similarity"))
    with_own = marked.join(own, F.col("row") == F.col("of"), "left").drop("row", "of")
    is_file = F.col("own_licence").isNotNull() & F.col("whole").isNotNull()
    judged = cut(with_own.select("id", "directory", "own_licence", "similarity", is_file.alias("is_file")), "own")
    plain = rows.where("row is null").select("id", "directory", F.lit(None).cast("string").alias("own_licence"), F.lit(None).cast("double").alias("similarity"), F.lit(False).alias("is_file"))
    per = judged.where("is_file").groupBy("directory", "own_licence").count()
    given = per.groupBy("directory").agg(F.min(F.struct((-F.col("count")).alias("c"), "own_licence")).alias("b")).select(F.col("directory").alias("path"), F.col("b.own_licence").alias("given"))
    up = rows.select("directory").distinct().select("directory", F.explode(ancestors(F.col("directory"))).alias("a")).select("directory", "a.path", "a.depth")
    near = up.join(given, "path").groupBy("directory").agg(F.max(F.struct("depth", "given", "path")).alias("b")).select(F.col("directory").alias("at"), "b.given", F.col("b.path").alias("from"))
    near = cut(near, "inherited")
    carried = F.broadcast(near) if near.count() <= BROADCAST_LINES else near
    out = judged.unionAll(plain).join(carried, F.col("directory") == F.col("at"), "left")
    source = F.when(F.col("own_licence").isNotNull(), ".").when(F.col("given").isNotNull(), F.concat(F.lit("/"), F.col("from")))
    return out.select(F.col("id").alias(id_col), "directory", "own_licence", "similarity", "is_file", F.coalesce("own_licence", "given").alias("licence"), source.alias("licence_from"))
