"""License scans: sparse TF-IDF cosine to notice templates, then inheritance from licence files.

Units of comparison are, in every file, the lines, runs of up to WINDOW adjacent lines, the sentences, and runs of up to WINDOW
adjacent paragraphs (headers and notices anywhere in a text, also wrapped or in comments) and, for licence
files, the whole text. A unit can reach the threshold with a template only if it shares one of the
template's anchor tokens: its heaviest tokens, function words and numbers last, taken until the rest alone could not
reach the threshold (Cauchy-Schwarz). Units without any anchor are left out by that bound, exactly; so are units with
so many words of no template that their norm alone keeps them under the threshold, and texts and units whose shared tokens
carry too little of every template.
Distinct units are scored once, however many files repeat them. Files without a notice of their own
take the licence of the nearest ancestor directory with a licence file, found by joins on
the distinct directories' ancestor paths.

DataFrame operations only.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.llm.shared import Scratch

THRESHOLD = 0.75

#: Distinct tokens that a unit shares with a template at least: one word ("mit" is German for "with") is no notice.
SHARED = 2

#: Adjacent lines, and paragraphs, that are compared together.
WINDOW = 6

#: Lines and paragraphs over this many characters are only compared by themselves.
LONGEST = 4000

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_BSD_DISCLAIMER = (
    "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, "
    "indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or "
    "profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) "
    "arising in any way out of the use of this software, even if advised of the possibility of such damage."
)


def _gnu(kind: str, name: str, version: str) -> str:
    return (
        f"This {kind} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version."
    )


# Licence identifiers with the wording of their usual notices, their headers, and the titles and
# distinctive passages of their texts. Titles like "MIT License" are left to the passages: the German word "mit" alone would reach them.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License);"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Redistributed under the BSD 2-Clause Simplified License."),
    ("BSD-3-Clause", "Redistributed under the BSD 3-Clause Revised License."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify and distribute this software under the ISC License is granted."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", _gnu("program", "GNU Affero General Public License", "3")),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", _BSD + _BSD_DISCLAIMER),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", _BSD_NAMES),
    ("BSD-3-Clause", _BSD + "3. " + _BSD_NAMES + " " + _BSD_DISCLAIMER),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", _gnu("program", "GNU General Public License", "2")),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", _gnu("program", "GNU General Public License", "3")),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies.",
    ),
    ("LGPL-2.0", "GNU Library General Public License Version 2, June 1991"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-2.1", _gnu("library", "GNU Lesser General Public License", "2.1")),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", _gnu("library", "GNU Lesser General Public License", "3")),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

# Short identifiers as they stand in SPDX tags; the GNU ones also with "-only" and "-or-later".
_TAGS = "AGPL-3.0 Apache-2.0 BSD-2-Clause BSD-3-Clause CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MIT MPL-2.0 Unlicense".split()
TEMPLATES += [(x, f"SPDX-License-Identifier: {x}{end}") for x in _TAGS for end in (("", "-only", "-or-later") if "GPL" in x else ("",))]

# English function words, poor anchors because most texts have them.
COMMON = set(
    "a all and any are as at be by can copy do either except file following for free in including into is it its may must names no nor not of on option or other out "
    "person persons provided rights shall so source such that the this to under use used v way whether with without work you".split()
)

LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"


def tokens(text: str) -> list[str]:
    return [x for x in re.split(r"[^a-z0-9]+", text.lower()) if x]


def inverse_frequency(n_templates: int, df: int) -> float:
    return math.log((1 + n_templates) / (1 + df)) + 1


def template_weights(templates: list[tuple[str, str]] = TEMPLATES) -> tuple[list[dict[str, float]], dict[str, float]]:
    """Unit-length sparse vectors of the templates, and the tokens' inverse frequencies."""
    bags = [Counter(tokens(text)) for _, text in templates]
    df = Counter(x for bag in bags for x in bag)
    idf = {x: inverse_frequency(len(bags), n) for x, n in df.items()}
    vectors = []
    for bag in bags:
        weight = {x: (1 + math.log(n)) * idf[x] for x, n in bag.items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        vectors.append({x: w / norm for x, w in weight.items()})
    return vectors, idf


def anchors(vectors: list[dict[str, float]], threshold: float) -> list[str]:
    """Tokens of which every unit within the threshold of some template has at least one."""
    out = set()
    for v in vectors:
        left = 1.0
        for x in sorted(v, key=lambda x: (x in COMMON or x.isdigit(), x not in out, -v[x], -len(x), x)):
            if left < threshold**2 - 1e-9:
                break
            out.add(x)
            left -= v[x] ** 2
    return sorted(out)


def _literal(value, kind: str) -> Column:
    """A constant of any type, small as an expression."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(words: Column, vectors: list[dict[str, float]], threshold: float) -> Column:
    """Whether the words (distinct tokens that templates have) hold enough of some template: by Cauchy-Schwarz the squared weights of the shared
    tokens sum to threshold^2 at least. It holds for a text if it holds for any unit of it."""
    every = _literal([[{"t": t, "w": w * w} for t, w in v.items()] for v in vectors], "array<array<struct<t:string,w:double>>>")

    def some(x: Column) -> Column:
        shared = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, e: acc + F.when(F.array_contains(x, e["t"]), e["w"]).otherwise(0.0))
        return (F.size(x) >= SHARED) & F.exists(every, lambda v: shared(v) >= threshold**2 - 1e-9)

    return _let(words, some)


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, "[^a-z0-9]+"), "")


def _in_reach(unit: Column, idf: dict[str, float], n_templates: int, threshold: float) -> Column:
    """Whether a unit's words of no template leave room for the threshold, an exact bound. With N tokens, n distinct ones, s of them in
    templates, the score is at most sqrt(Q / (Q + (n - s) u^2)), where u is the weight of other words and Q the squared weight of the s;
    they stand for at most N - (n - s) tokens, and (1 + ln x)^2 is concave from 1 on, so Q is largest if they share them evenly."""
    unseen = inverse_frequency(n_templates, 0)
    most = (1 / threshold**2 - 1) * (max(idf.values()) / unseen) ** 2 + 1e-3

    def room(x: Column) -> Column:
        other = F.size(F.array_distinct(x)) - F.size(F.array_intersect(x, _vocabulary(idf)))
        shared = F.size(F.array_intersect(x, _vocabulary(idf)))
        tf = 1 + F.log((F.size(x) - other) / F.greatest(shared, F.lit(1)))
        return (shared > 0) & (other <= F.lit(most) * shared * tf * tf)

    return F.exists(F.array(_tokens(unit)), room)


def _vocabulary(idf: dict[str, float]) -> Column:
    return _literal(sorted(idf), "array<string>")


def _near_templates(pieces: Column, idf: dict[str, float], anchored: list[str], n_templates: int, threshold: float, longest_run: int) -> Column:
    """The texts of runs of up to longest_run adjacent pieces that a cheap exact bound leaves: at least SHARED tokens of templates, an anchor, and room for
    the threshold. A piece is cut into tokens once, and runs are judged by sums over their pieces.

    With u the weight of a word of no template, the squared weight of a run's other words is u^2 for each distinct one at least, of which the run has as
    many as its richest piece; that of its template words is at most 4/e idf^2 for each occurrence, since (1 + ln x)^2 <= 4x/e. The score reaches
    the threshold only if the former is at most 1 / threshold^2 - 1 times the latter.
    """
    unseen = inverse_frequency(n_templates, 0)
    common = [x for x in idf if x in COMMON]
    rare = [x for x in idf if x not in COMMON]
    most = lambda some: (1 / threshold**2 - 1) * 4 / math.e * (max((idf[x] for x in some), default=0.0) / unseen) ** 2 + 1e-6

    def weighed(piece: Column) -> Column:
        def of(t: Column) -> Column:
            count = lambda some: F.size(F.filter(t, lambda x: x.isin(some)))
            other = F.size(F.array_distinct(F.filter(t, lambda x: ~x.isin(list(idf)))))
            return F.struct(piece.alias("text"), count(rare).alias("rare"), count(common).alias("common"), other.alias("other"), F.exists(t, lambda x: x.isin(anchored)).alias("anchor"))

        return _let(_tokens(piece), of)

    def kept(run: Column) -> Column:
        total = lambda f: F.aggregate(run, F.lit(0), lambda acc, x: acc + x[f])
        other = F.aggregate(run, F.lit(0), lambda acc, x: F.greatest(acc, x["other"]))
        return F.exists(run, lambda x: x["anchor"]) & (total("rare") + total("common") >= SHARED) & (other <= most(rare) * total("rare") + most(common) * total("common"))

    def runs(p: Column, n: int) -> Column:
        every = F.transform(p, lambda _, i: F.slice(p, i + 1, F.lit(n)))
        return F.transform(F.filter(every, kept), lambda r: F.array_join(F.transform(r, lambda x: x["text"]), "\n"))

    return _let(F.transform(pieces, weighed), lambda p: F.flatten(F.array(*[runs(p, n) for n in range(1, longest_run + 1)])))


def _best_match(units: DataFrame, threshold: float, templates: list[tuple[str, str]]) -> DataFrame:
    """unit, license and score of the units (a written table of distinct ones: uid, unit) that reach the threshold; ties go to the
    first licence by name. Only numbers and tokens are shuffled, not the units."""
    spark = units.sparkSession
    vectors, idf = template_weights(templates)
    weights = spark.createDataFrame([(k, templates[k][0], x, w) for k, v in enumerate(vectors) for x, w in v.items()], "template int, license string, token string, w double")
    rarity = spark.createDataFrame(list(idf.items()), "token string, idf double")
    unseen = inverse_frequency(len(vectors), 0)
    bag = units.select("uid", F.explode(F.split("unit", "[^a-z0-9]+")).alias("token")).filter("token != ''").groupBy("uid", "token").agg(F.count("*").alias("tf"))
    bag = bag.join(F.broadcast(rarity), "token", "left").select("uid", "token", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(unseen))).alias("q"))  # a row per template token
    norms = bag.groupBy("uid").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("norm"))
    dots = bag.join(F.broadcast(weights), "token").groupBy("uid", "template", "license").agg(F.sum(F.col("q") * F.col("w")).alias("dot"), F.count("*").alias("shared")).filter(F.col("shared") >= SHARED)
    scored = dots.join(norms, "uid").withColumn("score", F.round(F.col("dot") / F.col("norm"), 4)).filter(F.col("score") >= threshold)
    best = F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best")
    found = scored.groupBy("uid").agg(best).select("uid", F.col("best.license").alias("license"), (-F.col("best.s")).alias("score"))
    return units.join(found, "uid").select("unit", "license", "score")


def folder(path: Column) -> Column:
    """The directory of a path; the empty string at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def license_scan(files: DataFrame, id_col: str, path: Column, text_col: str = "text", threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Per row of files: its id, path, license (of its own notice, or null), score, effective_license,
    basis ("notice", "inherited" or "none") and from_dir (the directory that it inherits from).

    Null and empty texts have no notice; a null path has no directory and inherits nothing. Of several notices
    the best score decides, then the first licence by name; of several licence files in a directory likewise. Every row is kept, repeated ones
    and null ids too; rows with one id and path share their notices. Texts are read whole, whatever their length; lines and paragraphs over
    LONGEST characters are units by themselves but not part of longer ones. An empty table gives no rows.
    """
    scratch = Scratch(files.sparkSession, "licenses")
    vectors, idf = template_weights(templates)
    anchored = anchors(vectors, threshold)
    source = files.select(F.col(id_col).alias("id"), path.alias("path"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    licence_file = F.coalesce(base_name(F.col("path")).rlike(LICENCE_FILE), F.lit(False))
    found = source.filter(_covered(F.array_intersect(_tokens(F.col("t")), _vocabulary(idf)), vectors, threshold)).withColumn("lines", F.split("t", "\n")).withColumn("paragraphs", F.split("t", "\n(?:[^a-z0-9\n]*\n)+"))

    def short(pieces: Column) -> Column:
        return F.transform(F.filter(pieces, lambda x: x.rlike("[a-z0-9]")), lambda x: F.when(F.length(x) <= LONGEST, x).otherwise(F.lit("")))

    found = found.withColumn("near_lines", short(F.col("lines"))).withColumn("near_paragraphs", short(F.col("paragraphs")))
    sentences = F.flatten(F.transform("paragraphs", lambda x: F.split(x, r"(?<=\S\S[.!?])\s+")))
    near = lambda pieces, n: _near_templates(pieces, idf, anchored, len(templates), threshold, n)
    whole = F.when(licence_file, F.array("t")).otherwise(F.array().cast("array<string>"))
    adjacent = F.flatten(F.transform(F.array("near_lines", "near_paragraphs"), lambda pieces: near(pieces, WINDOW)))
    every = F.concat(near(F.concat("lines", "paragraphs", sentences, whole), 1), adjacent)
    units = found.select("id", "path", F.explode(F.array_distinct(every)).alias("unit"))
    units = units.select("id", "path", F.trim("unit").alias("unit")).filter(_in_reach(F.col("unit"), idf, len(templates), threshold))
    units = units.filter(_covered(F.array_intersect(_tokens(F.col("unit")), _vocabulary(idf)), vectors, threshold)).distinct()
    units = scratch.keep(units, "units")
    distinct = scratch.keep(units.select("unit").distinct().withColumn("uid", F.monotonically_increasing_id()), "distinct")
    matched = scratch.keep(_best_match(distinct, threshold, templates), "matched")
    best = F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best")
    own = units.join(matched, "unit").groupBy("id", "path").agg(best).select(F.col("id").alias("o_id"), F.col("path").alias("o_path"), F.col("best.license").alias("license"), (-F.col("best.s")).alias("score"))
    own = scratch.keep(own, "own")
    declared = own.filter(base_name(F.col("o_path")).rlike(LICENCE_FILE)).groupBy(folder(F.col("o_path")).alias("dir"))
    declared = declared.agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best")).select("dir", F.col("best.license").alias("dir_license"))
    declared = scratch.keep(declared, "declared")
    dirs = files.select(folder(path).alias("dir")).filter("dir is not null").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    # The top directory is "", which is also the one part that splitting "" gives.
    climbed = dirs.select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.above").join(declared.withColumnRenamed("dir", "above"), "above")
    nearest = climbed.groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_license")).alias("n")).select(F.col("dir").alias("n_dir"), F.col("n.above").alias("n_from"), F.col("n.dir_license").alias("n_license"))
    nearest = scratch.keep(nearest, "nearest")
    rows = files.select(F.col(id_col).alias(id_col), path.alias("path"), folder(path).alias("__dir"))
    rows = rows.join(own, rows[id_col].eqNullSafe(own["o_id"]) & rows["path"].eqNullSafe(own["o_path"]), "left").join(nearest, F.col("__dir") == F.col("n_dir"), "left")
    inherits = F.col("license").isNull() & F.col("n_license").isNotNull()
    return rows.select(
        id_col,
        "path",
        "license",
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("license", "n_license").alias("effective_license"),
        F.when(F.col("license").isNotNull(), "notice").when(inherits, "inherited").otherwise("none").alias("basis"),
        F.when(inherits, F.col("n_from")).alias("from_dir"),
    )


def path_of_documents(spark: SparkSession) -> Column:
    """Places documents in a tree: source / thousands / tens / name. Every tenth is its directory's LICENSE, every
    thousandth that of the directory above."""
    del spark
    d = F.col("doc_id")
    top = F.concat_ws("/", "source", F.floor(d / 1000).cast("string"))
    return F.when(d % 1000 == 0, F.concat(top, F.lit("/LICENSE"))).otherwise(
        F.concat_ws("/", top, F.floor(d / 10).cast("string"), F.when(d % 10 == 0, F.lit("LICENSE")).otherwise(F.concat(d.cast("string"), F.lit(".txt"))))
    )


def oracle_sql() -> str:
    """The same over documents in DuckDB SQL, with single lines and whole licence files as units and without any bound."""
    values = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
    return rf"""
WITH tpl(k, license, txt) AS (VALUES {values}),
tt AS (SELECT k, license, token, count(*) AS tf FROM (SELECT k, license, unnest(regexp_split_to_array(lower(txt), '[^a-z0-9]+')) AS token FROM tpl) WHERE token <> '' GROUP BY ALL),
idf AS (SELECT token, ln((1.0 + {len(TEMPLATES)}) / (1 + count(DISTINCT k))) + 1 AS idf FROM tt GROUP BY token),
tw AS (SELECT k, license, token, (1 + ln(tf)) * idf / sqrt(sum(((1 + ln(tf)) * idf) ** 2) OVER (PARTITION BY k)) AS w FROM tt JOIN idf USING (token)),
f AS (
  SELECT doc_id, lower(coalesce(text, '')) AS t,
         CASE WHEN doc_id % 1000 = 0 THEN source || '/' || doc_id // 1000 || '/LICENSE'
              ELSE source || '/' || doc_id // 1000 || '/' || doc_id // 10 || '/' || CASE WHEN doc_id % 10 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END END AS path
  FROM documents
),
u AS (
  SELECT DISTINCT doc_id, path, trim(unit) AS unit FROM (
    SELECT doc_id, path, unnest(string_split(t, chr(10)) || CASE WHEN path LIKE '%/LICENSE' THEN [t] ELSE [] END) AS unit FROM f)
),
bag AS (
  SELECT unit, token, count(*) AS tf FROM (SELECT unit, unnest(regexp_split_to_array(unit, '[^a-z0-9]+')) AS token FROM (SELECT DISTINCT unit FROM u)) WHERE token <> '' GROUP BY ALL
),
q AS (SELECT unit, token, (1 + ln(tf)) * coalesce(idf, ln(1.0 + {len(TEMPLATES)}) + 1) AS q FROM bag LEFT JOIN idf USING (token)),
n AS (SELECT unit, sqrt(sum(q * q)) AS norm FROM q GROUP BY unit),
s AS (SELECT unit, license, round(sum(q * w) / any_value(norm), 4) AS score FROM q JOIN tw USING (token) JOIN n USING (unit) GROUP BY unit, k, license HAVING count(*) >= {SHARED}),
m AS (SELECT unit, license, score FROM s WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY score DESC, license) = 1),
own AS (SELECT doc_id, path, license, score FROM u JOIN m USING (unit) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
decl AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS dir, license FROM own WHERE path LIKE '%/LICENSE'
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY score DESC, license) = 1
),
up AS (
  SELECT f.doc_id, decl.dir, decl.license AS dl FROM f JOIN decl ON starts_with(regexp_replace(f.path, '/[^/]*$', '') || '/', decl.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(decl.dir) DESC) = 1
)
SELECT f.doc_id, f.path, own.license, coalesce(own.score, 0) AS score, coalesce(own.license, up.dl) AS effective_license,
       CASE WHEN own.license IS NOT NULL THEN 'notice' WHEN up.dl IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
       CASE WHEN own.license IS NULL AND up.dl IS NOT NULL THEN up.dir END AS from_dir
FROM f LEFT JOIN own ON f.doc_id = own.doc_id LEFT JOIN up ON f.doc_id = up.doc_id
"""
