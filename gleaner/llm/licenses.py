"""License scans: TF-IDF cosine of headers and license files to templates, then inheritance along directories.

DataFrame and SQL functions only.  What is compared with the templates are the units of a file: each of its lines (a
notice inside other text), its header block (all up to the first empty line) and, if the file's name is that of
a license file, its whole text.  Units and templates, notices as well as full texts, are sparse TF-IDF vectors of
their words; document frequencies are those of all words over all lines of the corpus.  A unit can
reach the threshold only if it holds one of a template's anchor words (the heaviest, without
which the rest of the template is too light), so other units are passed over without a vector, and
frequencies are only gathered for words that stand in a unit with an anchor.

A file with a matching unit has that license.  Files named ``LICENSE``, ``LICENCE``, ``COPYING`` or ``NOTICE``, with or
without an ending and in any letter case, give theirs to their directory; a file with none of its own takes that of its
nearest ancestor directory that has one, found by joining the distinct directories' ancestors, not the files.

Defined cases: null texts and paths have no units and no directories; ties go to the template first by
name, of several license files in a directory the best match, then first path; repeated rows
each have theirs; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.once import with_once
from gleaner.llm.common import only
from gleaner.operators.joins import join_list
from gleaner.session import store

#: What a notice of each license says.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Full texts and the headers that go into source files.
TEXTS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written
permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details. You should have received a copy of the GNU General Public License along with this program.
If not, see https://www.gnu.org/licenses/.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The
above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
#: Several templates of one license are told apart by what follows a slash.
ALL_TEMPLATES = TEMPLATES | {f"{name}/text": text for name, text in TEXTS.items()}
THRESHOLD = 0.75
LICENSE_FILE = "(?i)^(licen[cs]e|copying|notice)([.-].*)?$"
TERM = "[a-z0-9]+([.-][a-z0-9]+)*"


def terms(text: str) -> list[str]:
    return [m.group() for m in re.finditer(TERM, text.lower())]


def _fold(text: Column) -> Column:
    """A-Z in lower case, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def document_frequencies(docs: DataFrame, templates: dict[str, str]) -> tuple[int, dict[str, int]]:
    """Number of lines with a character, and of lines that hold each word of the templates.

    Only template words leave a row, so the sums have one group per such word.
    """
    words = sorted({w for t in templates.values() for w in terms(t)})
    lines = F.filter(F.split(_fold(F.coalesce("text", F.lit(""))), "\n"), lambda x: x != "")
    split = docs.select(F.explode(lines).alias("line"))
    listed = F.array(*[F.lit(w) for w in words])
    held = F.array_intersect(listed, F.regexp_extract_all("line", F.lit(f"({TERM})"), F.lit(1)))
    counted = split.select(F.explode(F.array_append(held, F.lit(""))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    found = {r["w"]: r["n"] for r in counted.collect()}
    return found.pop("", 0), found


class Weights:
    """Inverse document frequencies, template vectors and anchor words."""

    def __init__(self, lines: int, frequencies: dict[str, int], templates: dict[str, str], threshold: float):
        self.lines = lines
        self.idf = lambda w: math.log(1 + lines / (1 + frequencies.get(w, 0)))
        self.vectors, anchors = {}, set()
        for name, text in sorted(templates.items()):
            counts: dict[str, int] = {}
            for w in terms(text):
                counts[w] = counts.get(w, 0) + 1
            vector = {w: n * self.idf(w) for w, n in counts.items()}
            norm = math.sqrt(sum(v * v for v in vector.values()))
            self.vectors[name] = {w: v / norm for w, v in vector.items()} if norm else {}
            left = 1.0
            for w, v in sorted(self.vectors[name].items(), key=lambda x: (-x[1], x[0])):
                if left < threshold**2 - 1e-9:
                    break
                anchors.add(w)
                left -= v * v
        self.anchors = sorted(anchors)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TERM})"), F.lit(1))


def _lines(text: Column) -> Column:
    return F.filter(F.split(_fold(F.coalesce(text, F.lit(""))), "\n"), lambda x: x != "")


def _units(path: Column, text: Column) -> Column:
    """The lines of a file, its header block, and its whole text if it is a license file; folded."""
    body = _fold(F.coalesce(text, F.lit("")))
    is_license = F.coalesce(F.element_at(F.split(path, "/"), -1).rlike(LICENSE_FILE), F.lit(False))
    whole = F.when(is_license, F.array(body)).otherwise(F.slice(F.array(body), 1, 0))
    return F.concat(_lines(text), F.array(F.substring_index(body, "\n\n", 1)), whole)


def _idf(terms_: DataFrame, docs: DataFrame, lines: int) -> DataFrame:
    """``term, idf`` of the listed terms, from all lines of the corpus."""
    listed = store(terms_.select("term").distinct(), "terms")
    held = docs.select(F.explode(_lines(F.col("text"))).alias("line")).select(F.explode(F.array_distinct(_terms(F.col("line")))).alias("term"))
    counted = join_list(held, listed, ["term"], "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    every = join_list(listed, store(counted, "frequencies"), ["term"], "left")
    return every.select("term", F.log(1 + lines / (1 + F.coalesce("df", F.lit(0)))).alias("idf"))


def unit_matches(docs: DataFrame, weights: Weights, key: list[str], threshold: float) -> DataFrame:
    """``key``, ``license``, ``score`` of the units and templates that reach the threshold."""
    anchors = F.array(*[F.lit(w) for w in weights.anchors]).cast("array<string>")
    units = docs.select(*key, F.posexplode(_units(F.col("path"), F.col("text"))).alias("unit", "body"))
    units = with_once(units, "_terms", _terms(F.col("body"))).where(F.arrays_overlap("_terms", anchors))
    each = units.select(F.struct(*key, "unit").alias("at"), F.explode("_terms").alias("term"))
    near = store(each.groupBy("at", "term").agg(F.count(F.lit(1)).alias("n")), "units")
    idf = store(_idf(near, docs, weights.lines), "idf")
    weighted = join_list(near, idf, ["term"]).select("at", "term", (F.col("n") * F.col("idf")).alias("x"))
    weighted = store(weighted, "weighted")
    rows = [{"template": name, "term": w, "w": v} for name, vector in weights.vectors.items() for w, v in vector.items()]
    listed = F.from_json(F.lit(json.dumps(rows)), "array<struct<template: string, term: string, w: double>>")
    vectors = docs.sparkSession.range(1).select(F.inline(listed))  # as long as the templates are
    norms = weighted.groupBy("at").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighted.join(F.broadcast(vectors), "term").groupBy("at", "template").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    scored = dots.join(norms, "at").withColumn("score", F.try_divide("dot", "norm")).where(F.col("score") >= threshold)
    license_ = F.substring_index("template", "/", 1).alias("license")
    return scored.select(*[F.col("at").getField(k).alias(k) for k in key], license_, F.round("score", 6).alias("score"))


def directory(path: Column) -> Column:
    """What comes before the last slash; null without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", ""))


def scan_licenses(files: DataFrame, templates: dict[str, str] = ALL_TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, path, own_license, own_score, license, from_dir`` of ``doc_id, path, text``.

    ``license`` is the file's own, else that of its nearest ancestor directory ``from_dir``.
    """
    files = only(files, "doc_id", "path", "text")
    weights = Weights(*document_frequencies(files, templates), templates, threshold)
    twin = F.xxhash64("path", "text").alias("twin")
    matches = unit_matches(files.select("doc_id", "path", twin, "text"), weights, ["doc_id", "path", "twin"], threshold)
    own = matches.groupBy("doc_id", "path", "twin").agg(
        F.max("score").alias("own_score"),
        F.min_by("license", F.struct((-F.col("score")).alias("s"), "license")).alias("own_license"),
    )
    own = store(own, "own")
    giving = own.where(F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE)).withColumn("dir", directory(F.col("path")))
    given = giving.where("dir IS NOT NULL").groupBy("dir").agg(
        F.min_by("own_license", F.struct((-F.col("own_score")).alias("s"), "path", "own_license")).alias("given")
    )
    given = store(given, "given")
    dirs = store(files.select(directory(F.col("path")).alias("dir")).where("dir IS NOT NULL").distinct(), "dirs")
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    ancestors = dirs.select(F.col("dir").alias("of"), F.posexplode(above).alias("depth", "dir"))
    nearest = join_list(ancestors, given, ["dir"]).groupBy("of").agg(
        F.max_by(F.struct(F.col("dir").alias("from_dir"), "given"), "depth").alias("near")
    )
    nearest = store(nearest.select(F.col("of").alias("dir"), "near.from_dir", "near.given"), "nearest")
    rows = files.select("doc_id", "path", twin, directory(F.col("path")).alias("dir"))
    at = lambda *c: F.struct(*c).alias("_at")
    keyed = rows.withColumn("_at", F.struct("doc_id", "path", "twin"))
    found = own.select(at("doc_id", "path", "twin"), "own_license", "own_score")
    joined = join_list(join_list(keyed, found, ["_at"], "left"), nearest, ["dir"], "left")
    return joined.select(
        "doc_id", "path", "own_license", "own_score",
        F.coalesce("own_license", "given").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("from_dir")).alias("from_dir"),
    )


#: Where documents lie when they are looked at as files: a rule on their columns.
PATH = (
    "concat(coalesce(source, 'none'), '/', coalesce(lang, 'none'), '/d', doc_id % 40, '/',"
    " CASE WHEN doc_id % 3 = 0 THEN concat('p', doc_id % 7, '/') ELSE '' END,"
    " CASE doc_id % 10 WHEN 0 THEN 'LICENSE' WHEN 1 THEN 'LICENSE' WHEN 2 THEN 'License.txt' WHEN 3 THEN 'COPYING'"
    " ELSE concat('f', doc_id, '.txt') END)"
)


def document_files(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.expr(PATH).alias("path"), "text")


def scan_sql(templates: dict[str, str] = ALL_TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The rows of the query in DuckDB: every unit with every template, every file with every directory above."""
    quoted = lambda t: t.lower().replace("'", "''")
    listed = ", ".join(f"('{n}', '{quoted(t)}')" for n, t in sorted(templates.items()))
    extract = lambda c: f"regexp_extract_all({c}, '{TERM}')"
    fold = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    is_license = f"regexp_matches(split_part(path, '/', -1), '{LICENSE_FILE}')"
    return f"""
    WITH templates(template, body) AS (VALUES {listed}),
    files AS (SELECT doc_id, {PATH} AS path, {fold} AS body FROM documents),
    lines AS (
      SELECT *, row_number() OVER () AS line_id FROM (
        SELECT doc_id, path, unnest(string_split(body, chr(10))) AS line FROM files) WHERE line <> ''),
    line_terms AS (SELECT DISTINCT line_id, term FROM (SELECT line_id, unnest({extract('line')}) AS term FROM lines)),
    template_terms AS (
      SELECT template, term, count(*) AS n FROM (SELECT template, unnest({extract('body')}) AS term FROM templates) GROUP BY ALL),
    units AS (
      SELECT *, row_number() OVER () AS unit_id FROM (
        SELECT doc_id, path, line AS body FROM lines
        UNION ALL SELECT doc_id, path, split_part(body, chr(10) || chr(10), 1) FROM files
        UNION ALL SELECT doc_id, path, body FROM files WHERE {is_license})),
    unit_terms AS (
      SELECT unit_id, term, count(*) AS n FROM (SELECT unit_id, unnest({extract('body')}) AS term FROM units) GROUP BY ALL),
    total AS (SELECT count(*) AS lines FROM lines),
    idf AS (
      SELECT t.term, ln(1 + (SELECT lines FROM total) / (1 + count(l.line_id))) AS idf
      FROM (SELECT term FROM template_terms UNION SELECT term FROM unit_terms) t LEFT JOIN line_terms l ON l.term = t.term GROUP BY t.term),
    vectors AS (
      SELECT template, t.term, n * idf / sqrt(sum(n * n * idf * idf) OVER (PARTITION BY template)) AS w
      FROM template_terms t JOIN idf USING (term)),
    norms AS (SELECT unit_id, sqrt(sum(n * n * idf * idf)) AS norm FROM unit_terms JOIN idf USING (term) GROUP BY unit_id),
    scores AS (
      SELECT unit_id, template, sum(n * idf * w) / any_value(norm) AS score
      FROM unit_terms JOIN idf USING (term) JOIN vectors USING (term) JOIN norms USING (unit_id)
      GROUP BY unit_id, template),
    best AS (
      SELECT doc_id, path, split_part(template, '/', 1) AS license, round(score, 6) AS score
      FROM scores JOIN units USING (unit_id) WHERE score >= {threshold}),
    own AS (
      SELECT doc_id, path, max(score) AS own_score, arg_min(license, (-score, license)) AS own_license FROM best GROUP BY ALL),
    given AS (
      SELECT regexp_replace(path, '/[^/]*$', '') AS dir, arg_min(own_license, (-own_score, path, own_license)) AS given
      FROM own WHERE {is_license} GROUP BY 1),
    dirs AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM files),
    nearest AS (
      SELECT d.dir, arg_max(g.dir, length(g.dir)) AS from_dir, arg_max(given, length(g.dir)) AS given
      FROM dirs d JOIN given g ON starts_with(d.dir || '/', g.dir || '/') GROUP BY d.dir)
    SELECT f.doc_id, f.path, own_license, own_score, coalesce(own_license, given) AS license,
      CASE WHEN own_license IS NULL THEN from_dir END AS from_dir
    FROM files f LEFT JOIN own o ON o.doc_id = f.doc_id AND o.path = f.path
    LEFT JOIN nearest n ON n.dir = regexp_replace(f.path, '/[^/]*$', '')"""
