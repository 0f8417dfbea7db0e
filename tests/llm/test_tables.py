"""URL filter, vector search and licence scan against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, kd_search, licences, queries, url_filter


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    edges += [(5, 5), (1, 0), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


URLS = [
    (1, "https://WWW.Example.com/en/1?x=/de/"), (2, "http://a.example.com/en/2"), (3, "http://x.com"), (4, "http://b.net/es/1"), (5, "http://b.net/de/1#/es/"),
    (6, None), (7, "no scheme"), (8, "http://listed.org/p.html?utm_source=a"), (9, "https://m.listed.org/p"), (9, "https://m.listed.org/p"), (10, "http://netx.org/es/"), (11, "x://y://z.net/fr/"),
]


def test_url_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in URLS], "page_id long, url string, host string, verdict string")
    listed = spark.createDataFrame([("listed.org/p",), ("listed.org/p",), (None,)], "key string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judged_urls(pages, listed, queries.URL_RULES).collect())
    assert got == [
        (1, "www.example.com", "/en/1", "www.example.com/en/", "allow"), (2, "a.example.com", "/en/2", "example.com/en/", "block"), (3, "x.com", "", None, "allow"),
        (4, "b.net", "/es/1", "net/es/", "block"), (5, "b.net", "/de/1", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"),
        (8, "listed.org", "/p.html", None, "block"), (9, "m.listed.org", "/p", None, "block"), (9, "m.listed.org", "/p", None, "block"), (10, "netx.org", "/es/", None, "allow"),
        (11, "y:", "//z.net/fr/", None, "allow"),
    ]
    assert url_filter.judged_urls(pages.limit(0), listed, queries.URL_RULES).count() == 0
    assert url_filter.judged_urls(pages, listed.limit(0), queries.URL_RULES).where("listed").count() == 0


def test_bloom_has_no_false_negative_and_few_positives(spark):
    keys = spark.range(2000).select(F.col("id").cast("string").alias("key"))
    blocks = url_filter.block_count(keys)
    made = url_filter.bloom_blocks(keys, blocks)
    asked = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    hits = {int(r.key) for r in url_filter.possible_hits(asked, made, blocks).collect()}
    assert hits >= set(range(2000)) and len(hits) < 2000 + 0.03 * 18_000


@pytest.mark.parametrize("shard_rows", [64, 10_000])
def test_top_k(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(kd_search, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(kd_search, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    vectors += [(i, vectors[7][1]) for i in range(300, 330)] + [(340, None), (350, [float("nan")] * 6), (360, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (370, [math.inf] * 6), (400, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<float>, dim int, x string")
    good = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in (i for i in good if i % 50 == 0):
        scored = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
        want |= {(q, r): (i, -s) for r, (s, i) in enumerate(scored, 1)}
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in kd_search.top_k(df).collect()}
    assert got == want
    assert kd_search.top_k(df.limit(0)).count() == 0


def test_tree_boxes_are_tight():
    rng = np.random.default_rng(3)
    v = rng.integers(-50, 50, (500, 4))
    tree = kd_search.Tree(np.arange(500), v)
    for (a, b), lo, hi in zip(tree.span, tree.low, tree.high, strict=True):
        assert (tree.vectors[a:b].min(axis=0) == lo).all() and (tree.vectors[a:b].max(axis=0) == hi).all()


def test_licences(spark):
    rows = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0.\nmore\nwords\nhere"), (2, "a/b/c/x.txt", "plain text"), (3, "a/b/LICENSE.txt", "Released under the MIT License."),
        (4, "a/b/c/y.txt", "x\n" * 5000 + "This work is licensed under the GNU General Public License, version 3.\n" + "y\n" * 5000), (5, "z/x.txt", "plain"), (6, None, None), (7, "a/q.txt", ""),
        (8, "ab/q.txt", "my driver's license expired yesterday in a far country and nobody noticed it"), (8, "ab/q.txt", ""),
    ]
    files = spark.createDataFrame([(*r, "c") for r in rows], "file_id long, path string, text string, licence string")
    got = {(r.file_id, r.licence, r.how, r.source_dir) for r in licences.licences(files, licences.template_table(spark)).collect()}
    assert got == {
        (1, "Apache-2.0", "own", None), (2, "MIT", "inherited", "a/b"), (3, "MIT", "own", None), (4, "GPL-3.0", "own", None), (5, None, "none", None),
        (6, None, "none", None), (7, "Apache-2.0", "inherited", "a"), (8, None, "none", None),
    }
    assert licences.licences(files.limit(0), licences.template_table(spark)).count() == 0


HEADER = """#!/bin/sh
# Copyright (c) 2019, Jane Roe
# All rights reserved.
#
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
# Redistributions of source code must retain the above copyright notice, this
# list of conditions and the following disclaimer.
echo start
"""
GRANT = (
    "Copyright 2021 A. Bee\n\nPermission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files, to deal\n"
    "in the Software without restriction, including the rights to use, copy, modify and sell copies,\nsubject to the following conditions:\n\nThe end."
)
#: Wordings that are no template, with what they should give.
WORDINGS = [
    ("Copyright 2020 Foo GmbH. All rights reserved.", "Proprietary"), ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This project is licensed under the terms of the MIT licence.", "MIT"), ("Code released under Apache License 2.0", "Apache-2.0"), (HEADER, "BSD-2-Clause"), (GRANT, "MIT"),
    ("Use of this source code is governed by the BSD 3-Clause license that can be found in the LICENSE file.", "BSD-3-Clause"),
    ("(c) 2018-2020 Jane Roe and others, released under MIT license", "MIT"), ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
    ("Some prose comes first. Content is available under CC BY-SA 4.0 unless otherwise noted. Then more prose of many words follows on the line.", "CC-BY-SA-4.0"),
    ("You can use this library under the GNU Lesser General Public License version 3.", "LGPL-3.0"), ("Distributed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("Licensed under the Artistic License, version 2.0.", None), ("Licensed under the Foo Public License, version 1", None), ("He lost his license to practice law in 2004.", None),
    ("Version 2.0 of the software was released under the name Apache Junction", None), ("The copyright of this song belongs to the band.", None),
    ("Please see the license for details.", None), ("A fishing license is required in this area under the terms of local law", None),
]


def test_licence_wordings(spark):
    files = spark.createDataFrame([(i, f"{i}/x.txt", t) for i, (t, _) in enumerate(WORDINGS)], "file_id long, path string, text string")
    got = {r.file_id: r.licence for r in licences.licences(files, licences.template_table(spark)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(WORDINGS)}


def test_every_template_needs_a_cue():
    """A unit holds all words that a template needs as terms, so it holds all parts of the cue that they hold: no cue drops a match."""
    import re

    for _, _, needs in licences.TEMPLATES:
        words = needs.split(" ")
        assert any(all(any(re.search(c, w) if c[0] == "\\" else c in w for w in words) for c in parts) for parts in licences.CUES), needs


def test_a_grant_without_its_usual_words(spark):
    text = GRANT.replace("hereby ", "")
    files = spark.createDataFrame([(1, "a/x.txt", text), (2, "b/x.txt", "This work comes by way of cc and 4.0, see elsewhere")], "file_id long, path string, text string")
    got = {r.file_id: r.licence for r in licences.licences(files, licences.template_table(spark)).collect()}
    assert got[1] == "MIT"


def test_top_k_of_shared_ids_and_large_parts(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 1.0]), (3, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in kd_search.top_k(df).orderBy("query_id", "rank").collect()] == [(0, 1, 2, 65536), (0, 2, 1, 0)]
    big = spark.createDataFrame([(0, [1e30, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        kd_search.top_k(big).collect()
