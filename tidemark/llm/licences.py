"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor.

DataFrame operations only. Whole texts are cut into units: blocks between blank lines (comment headers, licence texts),
lines, and sentences. Units that hold what some template needs are reduced to their wording, without comment signs, years and holders, and
grouped by it before any vector is made, so that a header which a third of all files carry is compared once. A file without
a licence of its own takes that of the nearest directory above it which holds a licence file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import write_table

# Names of licences and the words a notice must hold to mean them.
NAMES = [
    ("Apache-2.0", "Apache License, Version 2.0", "apache license"),
    ("MIT", "MIT License", "mit license"),
    ("BSD-2-Clause", "BSD 2-Clause License", "bsd 2-clause"),
    ("BSD-3-Clause", "BSD 3-Clause License", "bsd 3-clause"),
    ("ISC", "ISC License", "isc license"),
    ("GPL-2.0", "GNU General Public License, version 2", "gnu general license"),
    ("GPL-3.0", "GNU General Public License, version 3", "gnu general license"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1", "lesser general license"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3", "lesser general license"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3", "affero general license"),
    ("MPL-2.0", "Mozilla Public License, v. 2.0", "mozilla license"),
    ("EPL-2.0", "Eclipse Public License v2.0", "eclipse license"),
    ("BSL-1.0", "Boost Software License, Version 1.0", "boost license"),
    ("Zlib", "zlib License", "zlib license"),
    ("CC-BY-4.0", "CC BY 4.0", "cc by"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0", "cc by-sa"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0", "cc by-nc"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "creative commons attribution-sharealike"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "creative commons attribution-noncommercial"),
]
# Headers and licence texts.
BSD_TEXT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
TEXTS = [
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
        "or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache license",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject "
        "to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
        "permission granted charge software",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
        "permission granted fee software",
    ),
    ("BSD-2-Clause", BSD_TEXT, "redistribution source binary permitted"),
    (
        "BSD-3-Clause",
        BSD_TEXT + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
        "redistribution source binary permitted endorse",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "mozilla license",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
        "eclipse license",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unencumbered public domain",
    ),
    (
        "CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 "
        "Universal public domain dedication.",
        "cc0",
    ),
    ("Proprietary", "All rights reserved.", "rights reserved"),
    ("Proprietary", "Confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited.", "proprietary copying"),
]
# The GNU licences, what they are for, and the word that only their notices hold.
GNU = [
    ("GPL-2.0", "program", "", "2", "gnu"),
    ("GPL-3.0", "program", "", "3", "gnu"),
    ("LGPL-2.1", "library", "Lesser ", "2.1", "lesser"),
    ("LGPL-3.0", "library", "Lesser ", "3", "lesser"),
    ("AGPL-3.0", "program", "Affero ", "3", "affero"),
]
GNU_TEXT = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published "
    "by the Free Software Foundation, {which} This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
    "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more "
    "details. You should have received a copy of the GNU {kind}General Public License along with this {what}. If not, see http://www.gnu.org/licenses."
)
GNU_VERSIONS = ["version {v} of the License.", "either version {v} of the License, or (at your option) any later version."]
#: A unit is compared if it holds, in lower case, all parts of one of these. Each template needs words that hold all parts of one of them, so
#: what is left out could match none. A part that begins with a backslash is a pattern.
CUES = [
    ("licens",), ("licenc",), ("bsd", "-clause"), ("permission", "granted"), ("redistribution", "permitted"), ("creative", "commons"), ("by", r"\bcc\b"), ("cc0",), ("unencumbered",), ("rights", "reserved"), ("proprietary", "copying"),
]
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Years and holders of a copyright notice, up to what follows them.
HOLDER = r"(?:copyright|\(c\)|©)[ \t]*(?:\(c\)|©|by|[0-9][0-9][0-9][0-9])[^\n.]*?(\n|\.|all rights|licens|released|\z)"
#: The end of a run of comment lines, a blank line (of comment signs, maybe), the border of two sentences.
COMMENT_END = r"^([ \t]*(?:#|//|\*|;)[^\n]*)\n([ \t]*[^ \t#/*;\n])"
BLANK = r"\n(?:[ \t\r/*#;%<>!-]*\n)+"
SENTENCE = r"([.!?;])[ \t]+([A-Z(])"
FILE_NAMES = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice)(?:\.[a-z]+)?$"
#: Least cosine of a unit to a template that it may stand for.
THRESHOLD = 0.45


def _templates() -> list[tuple[str, str, str]]:
    """(licence, notice, words that a unit must hold)"""
    made = [(licence, f"{verb} under the {name}.", needs) for licence, name, needs in NAMES for verb in ("Licensed", "Released")]
    tags = [(licence, licence) for licence in dict.fromkeys(n[0] for n in NAMES)]
    tags += [(g[0], g[0] + suffix) for g in GNU for suffix in ("-only", "-or-later")]
    made += [(licence, f"SPDX-License-Identifier: {tag}", f"spdx-license-identifier {tag.lower()}") for licence, tag in tags]
    for licence, what, kind, v, word in GNU:
        made += [(licence, GNU_TEXT.format(what=what, kind=kind, which=which.format(v=v)), f"{word} general license") for which in GNU_VERSIONS]
    return made + TEXTS


TEMPLATES = _templates()


def wording(text: Column) -> Column:
    """Terms of a text in their order, without years and holders of copyright notices."""
    plain = F.replace(F.regexp_replace(F.lower(text), HOLDER, " $1"), F.lit("licence"), F.lit("license"))
    return F.array_join(F.regexp_extract_all(plain, F.lit(TERM), F.lit(0)), " ")


def _has_cue(text: Column) -> Column:
    low = F.lower(text)
    return reduce(Column.__or__, [reduce(Column.__and__, [low.rlike(c) if c[0] == "\\" else low.contains(c) for c in parts]) for parts in CUES])


def units(text: Column) -> Column:
    """Lines, sentences and blocks of a text, each once; parts without a cue are left out."""
    blocks = F.split(F.regexp_replace(text, "(?md)" + COMMENT_END, "$1\n\n$2"), BLANK)
    parts = F.concat(F.split(text, "\n"), F.split(F.regexp_replace(text, SENTENCE, "$1\n$2"), "\n"), blocks)
    return F.filter(F.array_distinct(parts), _has_cue)


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template int, licence string, line string, needs string")


def matched_wordings(wordings: DataFrame, templates: DataFrame, threshold: float) -> DataFrame:
    """(key, best): of each distinct wording of (key, wording) the (generic, less, licence), less being the negative cosine, if it reaches the threshold.

    Vectors carry the key, since a block may be as long as its text.

    A term of the templates weighs tf * (ln((1 + T) / (1 + df)) + 1), T and df being numbers of templates, so that a
    cosine does not change with the corpus; other terms (names, places) weigh tf. A template counts where the wording holds
    all words it needs. Of several the highest cosine is best, then the first licence by name; Proprietary comes last.
    """
    tv = templates.select("template", "licence", F.split("needs", " ").alias("needs"), F.explode(F.split(wording(F.col("line")), " ")).alias("term"))
    tv = tv.groupBy("template", "licence", "needs", "term").agg(F.count("*").alias("ttf"))
    total = templates.agg(F.count("*").alias("t"))
    idf = tv.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(total)).select("term", (F.log((1 + F.col("t")) / (1 + F.col("df"))) + 1).alias("idf"))
    tw = tv.join(idf, "term").select("template", "licence", "needs", "term", (F.col("ttf") * F.col("idf")).alias("tw"))
    norms = tw.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    # Dealt by key once; everything below keeps to it, and what is broadcast has a row for a term of a template at most.
    own = wordings.groupBy("key").agg(F.max("wording").alias("wording")).select("key", F.explode(F.split("wording", " ")).alias("term"))
    own = own.groupBy("key", "term").agg(F.count("*").alias("tf")).join(F.broadcast(idf), "term", "left")
    own = own.select("key", "term", F.col("idf").isNotNull().alias("known"), (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("w"))
    square = F.col("w") * F.col("w")
    vectors = own.groupBy("key").agg(
        F.sqrt(F.sum(square)).alias("norm"), F.sqrt(F.sum(F.when(F.col("known"), square))).alias("known_norm"),
        F.collect_list(F.when(F.col("known"), F.struct("term", "w"))).alias("vector"),
    )
    # No cosine exceeds the share of the norm that terms of the templates have.
    vectors = vectors.where(F.col("known_norm") >= (threshold - 1e-6) * F.col("norm")).select("key", "norm", F.explode("vector").alias("v"))
    needed = F.array_contains("needs", F.col("term")).cast("int")
    dots = vectors.select("key", "norm", "v.term", "v.w").join(F.broadcast(tw), "term").groupBy("key", "norm", "template", "licence", F.size("needs").alias("n_needs")).agg(
        F.sum(F.col("w") * F.col("tw")).alias("dot"), F.sum(needed).alias("held")
    ).where("held = n_needs")
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 9)
    scored = dots.join(F.broadcast(norms), "template").withColumn("cosine", cosine).where(F.col("cosine") >= threshold)
    generic = (F.col("licence") == "Proprietary").cast("int").alias("generic")
    return scored.groupBy("key").agg(F.min(F.struct(generic, (-F.col("cosine")).alias("less"), "licence")).alias("best"))


def licences(files: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(file_id, path, licence, cosine, how, source_dir) for every row of files (file_id, path, text).

    how: own (a unit of the file matches), inherited (from source_dir, the nearest ancestor with a licence file) or none.
    A licence file has a licence name, or a matching unit is half of its text or more. Of several units the highest cosine counts, then
    the first licence by name, a proprietary notice only where nothing else matches; of several licence files in a directory likewise.
    Null or empty texts have no unit; a null path has no ancestor. Rows that repeat a file_id each get the result of all of them,
    rows without file_id none of their own. Extra columns are ignored; an empty table gives an empty one.
    """
    rows = files.select("file_id", "path", F.coalesce("text", F.lit("")).alias("text"))
    each = rows.where(_has_cue(F.col("text"))).select("file_id", "path", F.length("text").alias("chars"), F.explode(units(F.col("text"))).alias("unit"))
    each = each.select("file_id", "path", "chars", F.length("unit").alias("size"), wording(F.col("unit")).alias("wording")).where("wording <> ''")
    each = write_table(each.withColumn("key", F.sha2("wording", 256)), "licence-units")
    best = write_table(matched_wordings(each, templates, threshold), "matched")
    named = F.coalesce(F.col("path").rlike(FILE_NAMES), F.lit(False))
    own = write_table(
        each.join(best, "key").groupBy("file_id", "path").agg(F.min("best").alias("best"), F.max(2 * F.col("size") >= F.col("chars")).alias("half"))
        .select("file_id", "path", "best", (F.col("half") | named).alias("is_licence_file")),
        "own-licences",
    )
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    dirs = own.where("is_licence_file and path is not null").groupBy(directory.alias("source_dir")).agg(F.min("best").alias("best"))
    paths = files.select("path").where("path is not null").select(directory.alias("dir")).distinct()
    parts = F.split("dir", "/")
    ancestors = paths.select("dir", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth")).select(
        "dir", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("source_dir")
    )
    nearest = ancestors.join(dirs, "source_dir").groupBy("dir").agg(F.max(F.struct("depth", "source_dir", "best")).alias("near"))
    mine = own.groupBy("file_id").agg(F.min("best").alias("own"))
    out = files.select("file_id", "path", directory.alias("dir")).join(mine, "file_id", "left").join(nearest, "dir", "left")
    has, near = F.col("own").isNotNull(), F.col("near").isNotNull()
    return out.select(
        "file_id", "path", F.when(has, F.col("own.licence")).otherwise(F.col("near.best.licence")).alias("licence"),
        F.when(has, -F.col("own.less")).otherwise(-F.col("near.best.less")).alias("cosine"),
        F.when(has, "own").when(near, "inherited").otherwise("none").alias("how"),
        F.when(~has, F.col("near.source_dir")).alias("source_dir"),
    )
