import os
import random
import zlib

import brute
import duckdb
import numpy as np
import pytest
from compare import connect, same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from inkveil.llm import chat, decontaminate, langid, licenses, quality, queries
from inkveil.llm.shared import crc_of_id


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    same(queries.queries()[name](spark, sf), connect(sf), queries.oracle_sql()[name])


def labelled(sf):
    return {r[0]: r[1] for r in duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()}


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    label = labelled(sf)
    rows = [r for r in queries.op7_quality_classifier(spark, sf).collect() if r["held_out"] and r["doc_id"] in label]
    assert sum(r["predicted"] == label[r["doc_id"]] for r in rows) >= 0.97 * len(rows) > 0


def test_quality_of_hard_rows(spark, docs_of, hard):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 1), (6, None), (99, 1)], "doc_id long, quality int")
    rows = [*hard, (None, "null id"), (3, "again")]
    out = quality.score_quality(docs_of(rows), labels, crc_of_id(F.col("doc_id")) % 3 != 1).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert quality.score_quality(docs_of([]), labels, F.lit(True)).count() == 0
    none = quality.score_quality(docs_of(hard), labels.limit(0), F.lit(True)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_quality_equals_plain_densities(spark):
    """Scores of all documents against statistics by loops, np.cov and log-densities by np.linalg."""
    sf = "/root/testdata/sf0.01"  # with enough rows of either class for a covariance of its own
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), labelled(sf)
    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id").cast("string")), F.lit(quality.KEPT_OUT)).alias("fold")).collect()
    known = [r for r in rows if labels.get(r["doc_id"]) in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    raw = {r["doc_id"]: brute.text_statistics(r["text"]) for r in rows}
    good = [raw[r["doc_id"]] for r in known if r["fold"] and labels[r["doc_id"]] == 1]
    x = {i: brute.quality_features(v, good, quality.MORE_BYTES, quality.MORE_WORDS) for i, v in raw.items()}
    density = []
    for c in (0, 1):
        own = np.array([x[r["doc_id"]] for r in known if r["fold"] and labels[r["doc_id"]] == c])
        cov = np.cov(own.T, bias=True)
        cov = (1 - quality.SHRINK) * cov + quality.SHRINK * np.diag(np.diag(cov)) + quality.FLOOR * np.eye(len(cov))
        n = sum(1 for r in known if r["fold"])
        density.append(lambda v, m=own.mean(0), i=np.linalg.inv(cov), d=np.linalg.slogdet(cov)[1], p=np.log((len(own) + 1) / (n + 2)): p - 0.5 * d - 0.5 * (v - m) @ i @ (v - m))
    odds = {i: density[1](v) - density[0](v) for i, v in x.items()}
    held = [(odds[r["doc_id"]], labels[r["doc_id"]]) for r in known if not r["fold"]]
    n = [sum(1 for _, c in held if c == k) for k in (0, 1)]
    target = (1 / (n[0] + 2), (n[1] + 1) / (n[1] + 2))
    loss = [sum(target[c] * np.logaddexp(0, -z / t) + (1 - target[c]) * np.logaddexp(0, z / t) for z, c in held) for t in quality.TEMPERATURES]
    t = quality.TEMPERATURES[int(np.argmin(loss))]
    got = {r["doc_id"]: r["score"] for r in queries.op7_quality_classifier(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, z in odds.items():
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(z / t, -700, 700))), rel=1e-6, abs=1e-9)


def test_texts_without_letters_take_the_share_of_their_kind(spark, docs_of):
    rows = [(k, "plain words of prose number " + "abcdefghij"[k % 10] * (k + 1)) for k in range(40)] + [(100 + k, t) for k, t in enumerate(["...", "1234", None, "", "!!!", "  "])]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(100, 0), (101, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs_of(rows), labels, F.lit(True)).collect()}
    base = 21 / 44
    assert all(got[100 + k] == pytest.approx(base / 3) for k in range(6))


def test_accepted_rows_are_those_predicted(spark, sf):
    docs, labels, t = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), crc_of_id(F.col("doc_id")) % 3 != 1
    want = {r["doc_id"] for r in quality.score_quality(docs, labels, t).collect() if r["predicted"]}
    left = quality.accepted(docs, labels, t)
    assert {r["doc_id"] for r in left.collect()} == want and left.columns == docs.columns


def test_language_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    rows = [r for r in queries.op2_language_id(spark, sf).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.97 * len(rows) > 0


def test_language_of_hard_rows(spark, docs_of, hard):
    out = {r["doc_id"]: r for r in langid.identify(docs_of([*hard, (90, "123 ... 4"), (None, "words")]), F.lit(True)).collect()}
    assert [out[i]["lang_pred"] for i in (0, 1, 2, 90)] == ["und"] * 4 and out[3]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in out.values()) and len(out) == len(hard) + 2
    assert {r["lang_pred"] for r in langid.identify(docs_of(hard), F.lit(False)).collect()} == {"und"}
    assert langid.identify(docs_of([]), F.lit(True)).count() == 0


def test_language_equals_plain_loops(spark, docs_of):
    rows = [(k, " ".join(w * (1 + k % 3) for w in words)) for k, words in enumerate([("the", "cat", "sat"), ("der", "Hund", "läuft")] * 20)]
    docs = docs_of([*rows, (90, "Größe the"), (91, "x"), (92, "1 2 é")]).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    model = langid.train(langid.sample(docs, F.lit(True), "doc_id", "text", "lang", 1000))
    got = {r["doc_id"]: r for r in langid.identify(docs, F.lit(True)).collect()}
    for i, text in docs.select("doc_id", "text").collect():
        data = bytes(b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 128 else 32 for b in text.encode())
        total, n = np.zeros(langid.DIMENSION), 0
        for size in langid.ORDERS:
            for k in range(len(data) - size + 1):
                h = size
                for b in data[k : k + size]:
                    h = ((h ^ b) * 16777619) % 2**32
                h = ((h ^ h >> 15) * 0x85EBCA6B) % 2**32
                total += model.embedding[h >> 19]
                n += 1
        z = np.array([(total / max(1, n)) @ model.weight[:, c] + model.bias[c] for c in range(2)]) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i]["lang_pred"] == model.languages[int(np.argmax(p))] and got[i]["score"] == pytest.approx(p.max(), abs=1e-4)


def test_too_many_languages_are_refused(spark, docs_of, monkeypatch):
    monkeypatch.setattr(langid, "ALL_LANGUAGES", 20)
    docs = docs_of([(k, f"text {k}") for k in range(9)])
    with pytest.raises(ValueError, match="too many"):
        langid.identify(docs.withColumn("lang", F.col("doc_id").cast("string")), F.lit(True))
    assert len(langid.sample(docs, F.lit(True), "doc_id", "text", "lang", 1000)) == 9


def test_segments_count_like_the_whole(monkeypatch):
    import numpy as np

    data = np.frombuffer(("Größe und Länge, one two " * 40).encode(), np.uint8)
    whole = langid.gram_counts(data)
    monkeypatch.setattr(langid.B, "SEGMENT", 64)
    assert (langid.gram_counts(data) == whole).all()


ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"), (2, "short item"), (3, None), (4, "..."), (5, "one"), (None, "null id item here"), (1, "alpha beta")]
NAMES = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_contamination_equals_brute_force(spark, docs_of, hard, monkeypatch):
    rows = [r for r in hard if len(r[1] or "") < 100_000] + [
        (50, "x " + ITEMS[0][1].upper() + " y"), (51, "beta gamma delta epsilon zeta eta theta iota kappa lambda-mu? nu"), (52, "a short, item. and SHORT\nitem"), (53, "beta gamma delta epsilon zeta eta theta iota kappa"), (54, " ".join(["one"] * 30)), (55, None), (56, "shortitem"),
    ]
    rows += [(50, "nothing"), (None, "null id item here"), (None, "one"), (None, None), (50, "x short item")]  # repeated and null ids
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute.contaminated(rows, ITEMS)
    for block in (200_000, 3, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
        found = decontaminate.report(decontaminate.contamination(docs_of(rows), items))
        assert sorted(map(str, found.select(*NAMES).toLocalIterator())) == sorted(str(Row(**dict(zip(NAMES, r, strict=True)))) for r in want)
        left = sorted((str(r["doc_id"]), str(r["text"])) for r in decontaminate.clean(docs_of(rows), items).collect())
        assert left == sorted((str(i), str(t)) for (i, t), r in zip(rows, want, strict=True) if not r[5])


def test_contamination_without_items_or_documents(spark, docs_of, hard):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs_of(hard), none).filter("size(spans) > 0").count() == 0
    assert decontaminate.clean(docs_of([]), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a: b", "x\\", "###", "\\:"]), st.text(st.sampled_from("\\#:/ <>turn\nA") | st.sampled_from(["### ", "</turn>", "\\###", "\\</turn>", ": "]).map(lambda x: x[0]), max_size=20)), max_size=4))
def test_chats_read_back(turns):
    text = chat.render(turns)
    assert [x[:2] for x in chat.parse(text)] == turns
    assert "".join(chat.unescape(text[a:b]) for a, b in chat.loss_spans(text)) == "".join(t for r, t in turns if r == "assistant")


@pytest.mark.parametrize("text", ["### user: a</turn>", "x", "### user: ### b</turn>\n", "### user a</turn>\n", "### user: a"])
def test_malformed_chats_are_refused(text):
    with pytest.raises(chat.Malformed):
        list(chat.parse(text))


def test_ordinary_text_is_not_escaped():
    assert chat.render_turn("user", r"C:\new # one") == "### user: C:\\new # one</turn>\n"


def test_conversations_with_nulls(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, None, "hi"), (None, 0, "user", "x"), (2, None, "assistant", "b"), (2, 0, "user", "a"), (2, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["text"] for r in chat.format_chats(rows).collect()}
    assert got == {1: "### : hi</turn>\n### assistant: </turn>\n", None: "### user: x</turn>\n", 2: "### assistant: b</turn>\n" + "### user: a</turn>\n" * 2}
    assert chat.digest(chat.format_chats(rows.limit(0))).count() == 0


def test_licenses_are_inherited_from_the_nearest_folder(spark):
    files = [
        (1, "p/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "p/a/b/x.py", "code"), (3, "p/a/LICENSE.txt", "intro\nReleased under the MIT License.\n"), (4, "p/a/b/y.py", "# Licensed under CC BY-NC 4.0."),
        (5, "q/z.py", None), (6, "top.py", ""), (7, None, "Released under the MIT License."), (8, "p/c/COPYING", "nothing here"), (9, "p/c/w", "the license is MIT, we think, released or so"), (9, "p/c/w", "again"),
    ]
    df = spark.createDataFrame(files, "id long, path string, text string")
    got = {(r["id"], r["license"], r["effective_license"], r["basis"], r["from_dir"]) for r in licenses.license_scan(df, "id", F.col("path")).collect()}
    assert got == {
        (1, "Apache-2.0", "Apache-2.0", "notice", None), (2, None, "MIT", "inherited", "p/a"), (3, "MIT", "MIT", "notice", None), (4, "CC-BY-NC-4.0", "CC-BY-NC-4.0", "notice", None),
        (5, None, None, "none", None), (6, None, None, "none", None), (7, "MIT", "MIT", "notice", None), (8, None, "Apache-2.0", "inherited", "p"), (9, None, "Apache-2.0", "inherited", "p"),
    }
    assert licenses.license_scan(df.limit(0), "id", F.col("path")).count() == 0


def test_a_licence_at_the_top_reaches_all(spark):
    df = spark.createDataFrame([(1, "LICENSE", "Released under the MIT License."), (2, "a/b.py", "x"), (3, "c.py", "x")], "id long, path string, text string")
    assert {(r["id"], r["effective_license"]) for r in licenses.license_scan(df, "id", F.col("path")).collect()} == {(1, "MIT"), (2, "MIT"), (3, "MIT")}


def licenses_of(spark, *texts, path="a.c"):
    df = spark.createDataFrame([(i, f"{i}/{path}", t) for i, t in enumerate(texts)], "id long, path string, text string")
    return [r["license"] for r in sorted(licenses.license_scan(df, "id", F.col("path")).collect(), key=lambda r: r["id"])]


APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'


def test_the_whole_apache_header_is_a_notice(spark):
    assert licenses_of(spark, f"# {APACHE}\ncode", "you may not use this file except in cases") == ["Apache-2.0", None]


def test_notices_inside_lines_and_over_several(spark):
    texts = {
        "Copyright 2020 Example Corp. All rights reserved. Released under the MIT License.": "MIT",
        "This tool reads tables and prints them. Released under the MIT License. See the site for more.": "MIT",
        "This work is licensed under the GNU General Public\nLicense, version 3.": "GPL-3.0",
        "/*\n * " + APACHE.replace("; you", ";\n * you") + "\n * You may obtain a copy elsewhere\n */": "Apache-2.0",
        "Some prose about a license, a public library and the version of a work. It is free.": None,
    }
    assert licenses_of(spark, *texts) == list(texts.values())


MIT_TEXT = """MIT License

Copyright (c) 2021 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD_TEXT = """Copyright (c) 2021, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
%s
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL_HEADER = """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version %d of the License, or
# (at your option) any later version.
"""
ISC_TEXT = """Copyright (c) 2021, Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
MPL_HEADER = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
SHARED = "/usr/share/common-licenses"


def test_real_licence_texts_and_headers(spark):
    texts = [(MIT_TEXT, "MIT"), (MIT_TEXT.split("\n", 2)[2], "MIT"), ("Licensed under the MIT License.", "MIT"), (BSD_TEXT % "", "BSD-2-Clause"), (BSD_TEXT % BSD_NAMES, "BSD-3-Clause"), (ISC_TEXT, "ISC"), (MPL_HEADER, "MPL-2.0"), (GPL_HEADER % 2, "GPL-2.0"), (GPL_HEADER % 3, "GPL-3.0"), ("Wir gehen. Mit. Mit der Zeit", None)]
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    for name, want in names.items():
        if os.path.exists(f"{SHARED}/{name}"):
            with open(f"{SHARED}/{name}", encoding="utf-8") as f:
                texts.append((f.read(), want))
    for path in ("LICENSE", "x.c"):
        assert licenses_of(spark, *[t for t, _ in texts], path=path) == [x for _, x in texts]


def test_anchors_bound_the_cosine():
    vectors, _ = licenses.template_weights()
    some = set(licenses.anchors(vectors, licenses.THRESHOLD))
    for v in vectors:
        assert sum(w * w for x, w in v.items() if x not in some) < licenses.THRESHOLD**2


@pytest.mark.parametrize("tag", ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-or-later", "LGPL-2.1", "BSD-3-Clause", "MPL-2.0"])
def test_tags_are_notices(spark, tag):
    assert licenses_of(spark, f"# SPDX-License-Identifier: {tag}\nx = 1\n", "# SPDX-License-Identifier: Zlib\n") == [tag.removesuffix("-only").removesuffix("-or-later"), None]


def test_one_word_is_no_notice(spark):
    assert licenses_of(spark, "Er ging. Mit.\nmit\n", "LICENSE\n\nGPL\n", "ISC", "MIT License") == [None, None, None, "MIT"]


def test_licenses_equal_brute_force(spark):
    """All units of texts that mix notices, wrapped and cut ones, prose and code, against all templates, without any bound."""
    rng = random.Random(11)
    prose = "the quick brown fox jumps over the lazy dog while rain falls on distant hills and nobody asks why".split()
    files = []
    for i in range(60):
        pieces = []
        for _ in range(rng.randint(1, 6)):
            words = rng.choice(licenses.TEMPLATES)[1].split() if rng.random() < 0.6 else [rng.choice(prose) for _ in range(rng.randint(3, 40))]
            words = [w for w in words if rng.random() < 0.97]
            wide = rng.choice([4, 9, 60])
            lines = [" ".join(words[k : k + wide]) for k in range(0, len(words), wide)]
            pieces.append(rng.choice(["\n", "\n# ", "\n * "]).join(lines))
        files.append((i, f"d{i % 7}/{'LICENSE' if i % 9 == 0 else f'{i}.c'}", rng.choice(["\n", "\n\n", ". ", "\n#\n"]).join(pieces)))
    files += [(100, "long/a.c", "x" * 100_000 + " Released under the MIT License. " + "y " * 50_000), (101, None, ""), (102, "z", None)]
    df = spark.createDataFrame(files, "id long, path string, text string")
    got = {r["id"]: (r["license"], r["score"]) for r in licenses.license_scan(df, "id", F.col("path")).collect()}
    want = {i: brute.license_of(t, path, licenses) for i, path, t in files}
    assert sum(x[0] is not None for x in want.values()) > 10
    for i, (name, score) in want.items():
        assert got[i][0] == name and got[i][1] == pytest.approx(score, abs=2e-4), i


def test_license_scan_keeps_other_columns_apart(spark):
    df = spark.createDataFrame([(1, "a/LICENSE", "Released under the MIT License.", 1, "u", "l"), (2, "a/b", "x", 2, "v", "m")], "id long, path string, text string, uid long, unit string, license string")
    assert [(r["id"], r["effective_license"]) for r in licenses.license_scan(df, "id", F.col("path")).orderBy("id").collect()] == [(1, "MIT"), (2, "MIT")]
