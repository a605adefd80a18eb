"""License scans: Dice coefficient over word bigrams against license templates, with DataFrame functions only."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.llm.common import Scratch, checked, spread, text_or_empty

THRESHOLD = 0.8

# License notices and texts as published by their stewards.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to this work to the public domain."),
]
#: Whole texts as published, one file for each license, beside the notices above.
TEMPLATES += [(p.stem, p.read_text(encoding="utf-8").strip()) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]
#: Templates of up to this many bigrams share one list of needed words; a longer one, which needs commoner words, has its own.
NOTICE = 100
#: Starts of spans are dealt into regions of a STARTS-th of a template.
STARTS = 6


def words_of(text: str) -> list[str]:
    """Words of a template: runs of A-Z, a-z and 0-9, in lower case."""
    return re.sub(r"[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).strip(" ").split(" ")


def template_rows(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[int, str, str, int, int]]:
    """(template, license, bigram, its count, bigrams in all): one row for each bigram of each template."""
    out = []
    for i, (name, text) in enumerate(templates):
        w = words_of(text)
        grams = Counter(" ".join(x) for x in zip(w, w[1:]))
        out += [(i, name, g, c, len(w) - 1) for g, c in sorted(grams.items())]
    return out


@functools.cache
def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Bigram counts whose Dice coefficient with a template of `size` bigrams can reach the threshold."""
    least = next(n for n in range(size + 1) if 2 * min(n, size) >= threshold * (n + size) - 1e-12)
    most = max(n for n in range(size, int(size * 2 / threshold) + 2) if 2 * size >= threshold * (n + size) - 1e-12)
    return least, most


def needed_words(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Words of which every match of any template has at least one.

    A match shares at least `common` bigrams with a template of b, so of any
    b - common + 1 of the template's bigrams it has one. Those with the longest
    words are taken, as likely the rarest, and of each its longer word.
    """
    out = set()
    for _, text in templates:
        w = words_of(text)
        grams = sorted(zip(w, w[1:]), key=lambda g: (-max(map(len, g)), g))
        least = size_bounds(len(grams), threshold)[0]
        common = math.ceil(threshold * (least + len(grams)) / 2 - 1e-9)
        out |= {max(g, key=lambda x: (len(x), x)) for g in grams[: len(grams) - common + 1]}
    return sorted(out)


def region_of(size: int, most: int) -> tuple[int, int]:
    """Bigrams that starts of spans are dealt by for a template of `size` bigrams, and bigrams of a region: all that a span with a start among these may hold."""
    step = max(1, size // STARTS)
    return step, step + most


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, unit, line_no, start_word, license, template, n_bigrams, common, dice: every match of a line, a whole text or a passage.

    Units are the lines of a text (line_no from 1), where it has several
    lines the whole text (line_no 0), and passages: spans of words wherever
    they start and end, over line ends too. A unit is normalised and its bag
    of word bigrams compared with each template's: 2 * common / (a + b), at
    least the threshold. For each line, text and license the best template is
    given (ties: the first in the list). A span's worth is what it shares
    beyond what the threshold asks of it, 2 * common - threshold * (a + b); a
    span counts if none with the same start or the same end is worth more, or
    as much and shorter. Spans that overlap are one passage, for which that of
    the most worth is given (ties: the first template, the first start, the
    shorter), with its first word from 0. Null and empty
    texts match nothing; a null key stays null; repeated rows count once, as
    one text of one key.
    """
    docs = spread(once(docs.select(key, text), key, text))
    return scan_units(docs, templates, threshold, key, text).unionByName(scan_passages(docs, templates, threshold, key, text))


def once(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs with one row for each key and text; only texts that are there twice are moved."""
    mark = F.xxhash64(F.col(key), text_or_empty(text))
    twice = Scratch(docs.sparkSession, "twice").save(docs.groupBy(mark.alias("_mark")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_mark"), "twice")
    if twice.isEmpty():
        return docs
    some = docs.withColumn("_mark", mark).join(checked(twice), "_mark", "left_semi").dropDuplicates([key, text]).drop("_mark")
    return docs.withColumn("_mark", mark).join(checked(twice), "_mark", "left_anti").drop("_mark").unionByName(some)


def _has(words: str, needed: list[str]) -> F.Column:
    """Whether an array of words has one of a list (of A-Z, a-z and 0-9), in any case."""
    return F.expr(f"exists({words}, w -> lower(w) in ({', '.join(map(repr, needed))}))")


def _words(text: F.Column) -> F.Column:
    return F.array_remove(F.split(text, "[^A-Za-z0-9]+"), "")


def scan_passages(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The passages of scan_licenses.

    Texts without a word that a match needs go first. Of the others, bigrams
    that templates have are counted by text and template (whole in one task,
    so the partial aggregation leaves a row for each); only where these can
    make a match are spans sought. What a span shares beyond the threshold is
    a sum over its bigrams, so the best span that starts within a few words
    is a running sum less the least one before it. Starts are dealt into
    regions of a sixth of the template, each with all bigrams that a span from
    there can hold within the size bounds; a bigram counts as often as the
    template has it, from the region's last start on. Of the span found, the
    end and then the start are set anew with exact counts.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    grams = template_rows(templates)
    bounds = {i: size_bounds(n, threshold) for i, _, _, _, n in grams}
    table = docs.sparkSession.createDataFrame([(*r, *region_of(r[4], bounds[r[0]][1]), bounds[r[0]][0]) for r in grams], "template int, license string, gram string, t_count int, t_size int, step int, width int, least int")
    needed = needed_words(templates, threshold)
    t = text_or_empty(text)

    def matched(rows: DataFrame) -> DataFrame:
        made = (
            rows.select(F.col(key).alias("doc_id"), F.xxhash64(t).alias("_hash"), F.explode(F.array(_words(t))).alias("words"))
            .filter(_has("words", needed) & (F.size("words") > 1))
            .select("doc_id", "_hash", F.posexplode(F.expr("transform(sequence(0, size(words) - 2), i -> lower(concat(words[i], ' ', words[i + 1])))")).alias("at", "gram"))
        )
        return made.join(F.broadcast(table), "gram")

    able = (
        matched(docs).groupBy("doc_id", "_hash", "template", "least").agg(F.count(F.lit(1)).alias("hits"))
        .filter("hits >= least").select("_hash", "template").distinct()
    )
    able = scratch.save(able, "able")
    some = docs.join(checked(scratch.save(able.select("_hash").distinct(), "texts")), F.xxhash64(t) == F.col("_hash"), "left_semi")
    hits = scratch.save(matched(some).join(checked(able), ["_hash", "template"], "left_semi").drop("least"), "hits")

    # Scores are in millionths: 2 for each bigram shared, less the threshold for each bigram of the span and of the template.
    shared, each = F.lit(2_000_000).cast("long"), F.lit(round(threshold * 1_000_000)).cast("long")
    region = ["doc_id", "_hash", "template", "k"]
    near = hits.withColumn("k", F.explode(F.expr("sequence(cast(greatest(0, ceil((at - width + 1) / step)) as int), cast(at div step as int))"))).withColumn("base", (F.col("k") + 1) * F.col("step") - 1)
    seen = F.count(F.when(F.col("at") >= F.col("base"), 1)).over(Window.partitionBy(*region, "gram").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    counted = near.withColumn("seen", seen).filter("seen <= t_count")
    along = Window.partitionBy(*region).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    scored = counted.withColumn("c", F.count(F.lit(1)).over(along)).withColumn("sum", shared * F.col("c") - each * F.col("at"))
    before = F.max(F.when(F.col("at") <= F.col("base"), F.struct((shared - each - F.col("sum")).alias("lead"), (-F.col("at")).alias("f")))).over(along)
    ends = scored.withColumn("from", before).filter("from is not null").withColumn("score", F.col("sum") + F.col("from.lead"))
    spans = (
        ends.groupBy(*region, "license", "t_size", "width", "step").agg(F.max(F.struct("score", (-F.col("at")).alias("e"), F.col("from.f").alias("f"))).alias("b"))
        .filter(F.col("b.score") >= each * F.col("t_size")).select("doc_id", "_hash", "template", "license", "t_size", (-F.col("b.f")).alias("start"), (-F.col("b.e")).alias("end"), (F.col("width") - F.col("step")).alias("most"))
    )
    spans = scratch.save(spans.distinct(), "spans")

    def refined(now: DataFrame, forward: bool) -> DataFrame:
        """The spans with their best end for the start (forward), or their best start for the end, by exact counts."""
        s = now.select(F.col("doc_id").alias("d"), F.col("_hash").alias("h"), F.col("template").alias("m"), "start", "end", "most")
        inside = F.col("at").between(F.col("start"), F.col("start") + F.col("most") - 1) if forward else F.col("at").between(F.col("end") - F.col("most") + 1, F.col("end"))
        rows = hits.join(s, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_hash") == F.col("h")) & (F.col("template") == F.col("m"))).filter(inside)
        fixed = ["doc_id", "_hash", "template", "license", "t_size", "most", "start" if forward else "end"]
        rows = rows.select(*fixed, "at", "gram", "t_count").distinct()  # several spans may share the end that stays
        way = "at" if forward else F.desc("at")
        rank = F.row_number().over(Window.partitionBy(*fixed, "gram").orderBy(way))
        common = F.sum((F.col("rank") <= F.col("t_count")).cast("int")).over(Window.partitionBy(*fixed).orderBy(way).rowsBetween(Window.unboundedPreceding, 0))
        size = (F.col("at") - F.col("start") if forward else F.col("end") - F.col("at")) + 1
        tried = rows.withColumn("rank", rank).withColumn("common", common).withColumn("size", size).withColumn("score", shared * F.col("common") - each * (F.col("size") + F.col("t_size")))
        best = F.max(F.struct("score", (-F.col("size")).alias("s"), "at", "common"))
        return tried.groupBy(*fixed).agg(best.alias("b")).select(*fixed, F.col("b.at").alias("end" if forward else "start"), "b.score", "b.common")

    exact = refined(refined(spans, True), False).filter("score >= 0").withColumn("n_bigrams", (F.col("end") - F.col("start") + 1).cast("int"))
    order = Window.partitionBy("doc_id", "_hash", "license").orderBy("start", "n_bigrams", "template")
    reached = F.max(F.col("start") + F.col("n_bigrams")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    passages = exact.withColumn("new", F.coalesce((F.col("start") >= reached).cast("int"), F.lit(1))).withColumn("passage", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.struct("template", "start", "n_bigrams", "common", "t_size"), F.struct("score", (-F.col("template")).alias("t"), (-F.col("start")).alias("s"), (-F.col("n_bigrams")).alias("n")))
    return passages.groupBy("doc_id", "_hash", "license", "passage").agg(best.alias("b")).select(
        "doc_id", F.lit("passage").alias("unit"), F.lit(None).cast("int").alias("line_no"), F.col("b.start").alias("start_word"), "license", "b.template", "b.n_bigrams", "b.common",
        F.round(2 * F.col("b.common") / (F.col("b.n_bigrams") + F.col("b.t_size")), 6).alias("dice"),
    )


def scan_units(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The lines and whole texts of scan_licenses.

    The number of words bounds the coefficient, so units outside every
    template's size bounds go before their bigrams are built, and so do units
    without any of the words that a match needs; the join on bigrams checks
    the bounds of each template. The template table has some ten thousand
    rows, a parameter of the code and not of the data; it is
    broadcast, and only bigrams that templates have are shuffled, as counts.
    """
    spark: SparkSession = docs.sparkSession
    grams = template_rows(templates)
    bounds = {i: size_bounds(n, threshold) for i, _, _, _, n in grams}
    table = spark.createDataFrame([(*r, *bounds[r[0]]) for r in grams], "template int, license string, gram string, t_count int, t_size int, least int, most int")
    groups: dict[int, list[int]] = {}
    for i, (_, txt) in enumerate(templates):
        if i in bounds:
            groups.setdefault(-1 if len(words_of(txt)) - 1 <= NOTICE else i, []).append(i)
    fits = F.lit(False)
    for group in groups.values():
        needed = needed_words([templates[i] for i in group], threshold)
        sized = F.lit(False)
        for lo, hi in sorted({bounds[i] for i in group}):
            sized = sized | F.col("n_bigrams").between(lo, hi)
        fits = fits | (sized & _has("raw", needed))
    top = max(hi for _, hi in bounds.values())
    t = text_or_empty(text)
    # Words of each line; a line beyond every bound is cut just past it, which keeps it (and its text) beyond the bound.
    words = lambda line: F.array_remove(F.split(line, "[^A-Za-z0-9]+", top + 5), "")
    # explode() of a one-element array makes the words an input of what follows; as a plain column they would be split
    # anew at each use.
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(t).alias("_hash"), F.explode(F.array(F.transform(F.split(t, "\n"), words))).alias("lines"))
    total = F.aggregate("lines", F.lit(0), lambda n, w: n + F.size(w))
    whole = F.when((F.size("lines") > 1) & (total <= top + 1), F.flatten("lines")).otherwise(F.array().cast("array<string>"))
    units = (
        rows.select("doc_id", "_hash", F.posexplode(F.concat(F.array(whole), F.col("lines"))).alias("line_no", "raw"))
        .withColumn("n_bigrams", F.size("raw") - 1)
        .filter(fits)
        .select("doc_id", "_hash", "line_no", "n_bigrams", F.explode(F.expr("transform(sequence(0, n_bigrams - 1), i -> lower(concat(raw[i], ' ', raw[i + 1])))")).alias("gram"))
    )
    found = (
        units.join(F.broadcast(table), "gram").filter("n_bigrams between least and most")
        .groupBy("doc_id", "_hash", "line_no", "n_bigrams", "template", "license", "t_size", "gram", "t_count").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("doc_id", "_hash", "line_no", "n_bigrams", "template", "license", "t_size").agg(F.sum(F.least("n", "t_count")).alias("common"))
        .withColumn("dice", F.round(2 * F.col("common") / (F.col("n_bigrams") + F.col("t_size")), 6))
        .filter(F.col("dice") >= threshold)
    )
    best = F.max_by(F.struct("template", "common", "dice"), F.struct("dice", (-F.col("template")).alias("t")))
    return found.groupBy("doc_id", "_hash", "line_no", "license", "n_bigrams").agg(best.alias("b")).select(
        "doc_id", F.when(F.col("line_no") == 0, "text").otherwise("line").alias("unit"), "line_no", F.lit(None).cast("int").alias("start_word"), "license",
        "b.template", "n_bigrams", "b.common", "b.dice",
    )


def oracle_sql(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same over table documents in DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {q(n)}, {q(t)})" for i, (n, t) in enumerate(templates))
    norm = lambda c: f"trim(regexp_replace(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' ')"
    return f"""
    with t as (select template, license, string_split({norm('txt')}, ' ') w from (values {values}) v(template, license, txt)),
    tg as (select template, license, len(w) - 1 t_size, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) gram from t),
    tc as (select template, license, t_size, gram, count(*) t_count from tg group by all),
    d as (select distinct doc_id, coalesce(text, '') text from documents),
    l as (select doc_id, text, string_split(text, chr(10)) ls from d),
    u as (select doc_id, text, unnest(range(1, len(ls) + 1)) line_no, unnest(ls) raw from l
          union all select doc_id, text, 0, text from l where len(ls) > 1),
    uw as (select doc_id, hash(text) h, line_no, string_split({norm('raw')}, ' ') w from u where raw <> ''),
    s as (select *, len(w) - 1 n_bigrams from uw),
    ug as (select doc_id, h, line_no, n_bigrams, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) gram from s
           where exists (select 1 from (select distinct t_size from tc) z where 2 * least(n_bigrams, t_size) >= {threshold} * (n_bigrams + t_size) - 1e-9)),
    c as (select doc_id, h, line_no, n_bigrams, gram, count(*) n from ug group by all),
    f as (select doc_id, h, line_no, n_bigrams, template, license, t_size, sum(least(n, t_count)) common from c join tc using (gram) group by all),
    g as (select *, round(2.0 * common / (n_bigrams + t_size), 6) dice from f),
    pw as (select doc_id, hash(text) h, string_split({norm('text')}, ' ') w from d where text <> ''),
    pg as (select doc_id, h, len(w) - 1 n, unnest(range(0, len(w) - 1)) pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) gram from pw),
    pm as (select doc_id, h, pos, gram, template, license, t_size, t_count, lag(pos, t_count::int) over (partition by doc_id, h, template, gram order by pos) same from pg join tc using (gram)),
    pa as (select * from pm qualify count(*) over (partition by doc_id, h, template) >= {threshold} / (2 - {threshold}) * t_size - 1e-9),
    ps as (select a.doc_id, a.h, a.template, a.license, a.t_size, a.pos start, b.pos - a.pos + 1 size, count(*) filter (where coalesce(b.same, -1) < a.pos) over (partition by a.doc_id, a.h, a.template, a.pos order by b.pos rows unbounded preceding) common
           from pa a join pa b on a.doc_id is not distinct from b.doc_id and a.h = b.h and a.template = b.template and b.pos between a.pos and a.pos + floor((2 - {threshold}) / {threshold} * a.t_size + 1e-9)),
    pb as (select *, 2000000 * common - {round(threshold * 1_000_000)} * (size + t_size) score from ps),
    px as (select * from pb where score >= 0 qualify row_number() over (partition by doc_id, h, template, start order by score desc, size) = 1
           and row_number() over (partition by doc_id, h, template, start + size order by score desc, size) = 1),
    pi as (select *, case when start < max(start + size) over o then 0 else 1 end fresh from px
           window o as (partition by doc_id, h, license order by start, size, template rows between unbounded preceding and 1 preceding)),
    pp as (select *, round(2.0 * common / (size + t_size), 6) dice, sum(fresh) over (partition by doc_id, h, license order by start, size, template rows unbounded preceding) passage from pi)
    select doc_id, case when line_no = 0 then 'text' else 'line' end unit, line_no::int line_no, null::int start_word, license, template, n_bigrams::int n_bigrams, common::bigint common, dice
    from (select * from g where dice >= {threshold}
          qualify row_number() over (partition by doc_id, h, line_no, license order by dice desc, template) = 1)
    union all
    select doc_id, 'passage', null, start::int, license, template, size::int, common::bigint, dice
    from (select * from pp qualify row_number() over (partition by doc_id, h, license, passage order by score desc, template, start, size) = 1)
    """
