"""Licence scans, with DataFrame functions only: normalised text against licence templates by the Dice coefficient
over word bigrams.

Compared are three kinds of segment: every line, every paragraph of several lines (between blank lines) and every
text of several paragraphs. Normalising lower-cases, turns all that is no letter or digit into one blank and trims.
Dice is 2 |A and B| / (|A| + |B|) over the sets of word bigrams. A segment with a bigrams can reach ``least`` with
a template of b only if b least / (2 - least) <= a <= b (2 - least) / least; these bounds prune templates.

Everything happens within a row. Every segment's bigrams are bigrams of its text, and a match shares at least
b least / (2 - least) of them with the template. So a text is first asked which templates' bigrams it holds in that
number; the few texts that hold any are written to the shared folder, and only they are cut into segments, which meet
only the templates of their text. Templates are constants of the plan: at most ``HELD`` bigrams at a time; a larger set is
taken in slices, and the best of the slices' results counts.

Besides, notices that no such segment holds are found in runs of adjacent sentences, across lines and paragraphs (kind
``run``, ``place`` counts sentences of one word or more from 0). A run counts if its words make m low .. m high bigrams,
repeats included, for the template's m. Its first and last sentence share a bigram with the template, as others only
lower the score. Runs that touch a line, paragraph or text that reaches ``least`` with the same template are left to it;
of overlapping runs of one licence the best is kept, then the shortest, then the first.

Defined results: null text = empty text = no match. A segment's best template is kept, ties to the smaller
``licence``. Repeated rows match as often as they occur. An empty table gives none. Long texts are read whole. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

LEAST = 0.8
#: Bigrams of templates that one plan holds.
HELD = 200_000

# Public licence notices, as their licences word them or as files commonly quote them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "all-rights-reserved-line": "All rights reserved.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-line": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def bigrams(text: str) -> str:
    """SQL for the distinct word bigrams of the normalised SQL expression ``text``."""
    normal = f"trim(regexp_replace(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))"
    return f"transform(array(split({normal}, ' ')), w -> array_distinct(transform(slice(w, 1, greatest(size(w) - 1, 0)), (x, i) -> concat(x, ' ', w[i + 1]))))[0]"


def words(text: str) -> str:
    """SQL for the words of the normalised SQL expression ``text``."""
    return f"filter(split(regexp_replace(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '), ' '), x -> x != '')"


def pairs_of(w: str) -> str:
    """SQL for the distinct bigrams of an array of words, which is evaluated once."""
    return f"transform(array({w}), v -> array_distinct(transform(slice(v, 1, greatest(size(v) - 1, 0)), (x, i) -> concat(x, ' ', v[i + 1]))))[0]"


def dice(grams: str) -> str:
    """SQL for the Dice coefficient of distinct bigrams and those of the template ``t``."""
    return f"transform(array({grams}), g -> 2D * size(array_intersect(g, t.b)) / (size(g) + size(t.b)))[0]"


def runs(some: DataFrame, least: float) -> DataFrame:
    """(__id, __row, kind, place, licence, score) of the runs in the rows (__id, __row, __t) with their templates ``ts``."""
    low, high = least / (2 - least), (2 - least) / least
    once = lambda x: F.explode(F.expr(f"array({x})"))  # noqa: E731  a generator: what reads the column does not repeat it
    some = some.withColumn("t", F.explode("ts")).drop("ts")
    grams = pairs_of(words("z"))
    sentences = f"filter(transform(split(l, '(?<=[.!?])\\\\s+'), s -> named_struct('w', {words('s')}, 'held', lheld or pheld or theld)), u -> size(u.w) > 0)"
    reaches = lambda x: f"({dice(grams.replace('lower(z)', f'lower({x})'))} >= {least})"
    lines = f"flatten(transform(split(p, '\\n'), l -> transform(array({reaches('l')}), lheld -> {sentences})[0]))"
    units = f"flatten(transform(split(__t, '\\n[ \\t\\r]*\\n'), p -> transform(array({reaches('p')}), pheld -> {lines})[0]))"
    some = some.withColumn("u", once(f"transform(array({reaches('__t')}), theld -> {units})[0]"))
    around = "concat(if(k > 0, slice(u[k - 1].w, -1, 1), cast(array() as array<string>)), u[k].w, if(k + 1 < size(u), slice(u[k + 1].w, 1, 1), cast(array() as array<string>)))"
    touching = f"filter(sequence(0, size(u) - 1), k -> not u[k].held and arrays_overlap({pairs_of(around)}, t.b))"
    some = some.filter("size(u) > 0").withColumn("at", once(touching))
    # sentences of one word at least: a run has no more of them than words
    some = some.withColumn("from", F.explode("at")).withColumn("to", F.explode(F.expr(f"filter(at, j -> j >= from and j - from <= size(t.b) * {high})")))
    some = some.withColumn("r", once("slice(u, from + 1, to - from + 1)")).filter("not exists(r, x -> x.held)")
    some = some.withColumn("w", once("flatten(transform(r, x -> x.w))")).filter(f"size(w) - 1 between size(t.b) * {low} - 1e-9 and size(t.b) * {high} + 1e-9")
    some = some.select("__id", "__row", "t.licence", "from", "to", once(dice(pairs_of("w"))).alias("score")).filter(F.col("score") >= least)
    found = some.groupBy("__row", "__id", "licence").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), (F.col("to") - F.col("from")).alias("n"), "from", "to"))).alias("a"))
    best = "aggregate(a, slice(a, 1, 0), (acc, r) -> if(exists(acc, x -> x.from <= r.to and r.from <= x.to), acc, concat(acc, array(r))))"
    return found.withColumn("x", F.explode(F.expr(best))).select("__id", "__row", F.lit("run").alias("kind"), F.col("x.from").alias("place"), "licence", (-F.col("x.s")).alias("score"))


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    """(licence, template) rows."""
    rows = sorted((templates or TEMPLATES).items())
    return spark.createDataFrame(rows, "licence string, template string")


def candidates(rows: DataFrame, held: list[tuple[str, list[str]]], least: float) -> DataFrame:
    """(__id, __row, __t, ts): the rows whose texts hold enough bigrams of some templates, with these templates."""
    low = least / (2 - least)
    constant = F.from_json(F.lit(json.dumps([{"licence": k, "b": b} for k, b in held])), "array<struct<licence:string,b:array<string>>>")
    every = F.from_json(F.lit(json.dumps(sorted({g for _, b in held for g in b}))), "array<string>")
    # a generator in between: the bigrams of a text are made once
    hit = rows.withColumn("hit", F.explode(F.array(F.array_intersect(F.expr(bigrams("__t")), every)))).filter("size(hit) > 0")
    enough = F.filter(constant, lambda t: F.size(F.array_intersect(F.col("hit"), t["b"])) >= F.size(t["b"]) * low - 1e-9)
    found = hit.withColumn("ts", F.explode(F.array(enough))).filter("size(ts) > 0").drop("hit")
    return materialize(found, "licence-texts")


def segments(some: DataFrame, least: float) -> DataFrame:
    """(__id, __row, kind, place, licence, score) of lines, paragraphs and texts whose best template reaches ``least``."""
    low, high = least / (2 - least), (2 - least) / least
    parts = """concat(
        transform(split(__t, '\\n'), (t, i) -> named_struct('kind', 'line', 'place', i, 't', t)),
        filter(transform(split(__t, '\\n[ \\t\\r]*\\n'), (t, i) -> named_struct('kind', 'paragraph', 'place', i, 't', t)), p -> instr(p.t, '\\n') > 0),
        if(__t rlike '\\n[ \\t\\r]*\\n', array(named_struct('kind', 'text', 'place', 0, 't', __t)), array()))"""
    cut = some.withColumn("p", F.explode(F.expr(parts))).select("__id", "__row", "ts", "p.kind", "p.place", F.expr(bigrams("p.t")).alias("b"))
    near = f"filter(ts, t -> size(b) between size(t.b) * {low} - 1e-9 and size(t.b) * {high} + 1e-9)"
    scored = f"transform({near}, t -> named_struct('s', -2D * size(array_intersect(b, t.b)) / (size(b) + size(t.b)), 'licence', t.licence))"
    best = cut.withColumn("x", F.explode(F.expr(f"array(array_min({scored}))"))).filter(F.col("x.s") <= -least)
    return best.select("__id", "__row", "kind", "place", "x.licence", (-F.col("x.s")).alias("score"))


def find(docs: DataFrame, templates: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """(id, kind, place, licence, score) for every segment whose best template reaches ``least``.

    ``kind`` is line, paragraph, text or run; ``place`` counts the segments of a kind in the text from 0.
    """
    known = templates.select("licence", F.expr(bigrams("template")).alias("b")).filter("size(b) > 0")
    slices, room = [[]], held
    for row in known.orderBy("licence").toLocalIterator():  # one slice after another; a plan holds one
        if slices[-1] and room < len(row["b"]):
            slices.append([])
            room = held
        slices[-1].append((row["licence"], row["b"]))
        room -= len(row["b"])
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), text.alias("__t"), F.monotonically_increasing_id().alias("__row"))
    if len(slices) > 1:
        rows = materialize(rows, "licence-rows")  # the slices must agree on the rows' numbers
    each = [candidates(rows, part, least) for part in slices]
    best, found = (functools.reduce(DataFrame.unionByName, [make(some, least) for some in each]) for make in (segments, runs))
    if len(slices) > 1:
        one = best.groupBy("__id", "__row", "kind", "place").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("x"))
        best = one.select("__id", "__row", "kind", "place", "x.licence", (-F.col("x.s")).alias("score"))
    found = best.unionByName(found)
    return found.select(F.col("__id").alias(id_col), "kind", F.col("place").cast("long").alias("place"), "licence", "score")


def oracle(templates: dict[str, str] | None = None, least: float = LEAST) -> str:
    """DuckDB SQL for the same rows of ``documents``, comparing every segment with every template."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted((templates or TEMPLATES).items()))
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    normal = "string_split(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT rid, doc_id, 'line' AS kind, unnest(range(len(string_split(t, chr(10))))) AS place, unnest(string_split(t, chr(10))) AS t FROM d
  UNION ALL SELECT * FROM (SELECT rid, doc_id, 'paragraph' AS kind, unnest(range(len(string_split_regex(t, '\\n[ \\t\\r]*\\n')))), unnest(string_split_regex(t, '\\n[ \\t\\r]*\\n')) AS t FROM d) WHERE contains(t, chr(10))
  UNION ALL SELECT rid, doc_id, 'text', 0, t FROM d WHERE regexp_matches(t, '\\n[ \\t\\r]*\\n')
),
sb AS (SELECT rid, doc_id, kind, place, {grams} AS b FROM (SELECT *, {normal.format('t')} AS w FROM s)),
tb AS (SELECT licence, {grams} AS b FROM (SELECT *, {normal.format('template')} AS w FROM (VALUES {values}) v(licence, template))),
x AS (
  SELECT rid, doc_id, kind, place, licence, 2.0 * len(list_intersect(sb.b, tb.b)) / (len(sb.b) + len(tb.b)) AS score
  FROM sb, tb WHERE len(sb.b) > 0 AND list_has_any(sb.b, tb.b)
)
SELECT doc_id, kind, CAST(place AS BIGINT) AS place, licence, CAST(score AS DOUBLE) AS score FROM x WHERE score >= {least}
QUALIFY row_number() OVER (PARTITION BY rid, kind, place ORDER BY score DESC, licence) = 1"""
