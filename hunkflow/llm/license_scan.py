"""License scans by diagonal voting, with DataFrame operations only.

Every rolling k-gram of a text's words is hashed and joined to the positions
of the same k-gram in the license templates. A hit votes for the diagonal
(text position minus template position) it lies on; votes add up per text,
template and diagonal, and diagonals that differ by a few words are merged.

A merged span with enough votes is then verified. If one of its diagonals holds
the whole template, it is as it should be. Of the others the hits say which words
of the template stand where in the text; all other words of the span count as
strange. Span and template are written with one letter per word,
and their edit distance must stay below a tenth of the template's words, so
short names must stand word for word and long notices may differ a little.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import table, text_or_empty

K = 3
NEIGHBOURS = 3  # diagonals this close belong to one span
VOTES = 2  # a span goes on if its hits cover one in so many of the template's words
EDITS = 10  # and counts if it needs at most one edit for so many of them
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII characters that separate words once A-Z are small letters.
_BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_STRANGE = " "  # the letter of a word that no hit accounts for

#: Phrases whose every place counts, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# fixed values: public license texts
#: (label, text): the lines by which works name their license, and the texts of
#: short licenses by paragraph.
TEMPLATES = [
    ("mit", "under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("reserved", "All rights reserved"),
]


def _template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _letters(words: list[str]) -> str:
    """One printable letter per word, equal for equal words of a template."""
    known: dict[str, str] = {}
    code = "".join(known.setdefault(w, chr(33 + len(known))) for w in words)
    if len(known) > 94:
        raise ValueError("a template may have at most 94 different words: cut it into paragraphs")
    return code


def template_rows(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple]:
    """(template, tpos, label, code, w0, w1, w2) of every k-gram."""
    return [(n, p, label, _letters(w), *w[p : p + K]) for n, (label, text) in enumerate(templates) for w in [_template_words(text)] for p in range(len(w) - K + 1)]


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(template, tpos, label, code, w0, w1, w2, h): under a thousand rows, fixed by the code."""
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("template", "tpos")] + [T.StructField(c, T.StringType()) for c in ("label", "code", *(f"w{i}" for i in range(K)))])
    return spark.createDataFrame(template_rows(templates), schema).withColumn("h", F.xxhash64(*(f"w{i}" for i in range(K))))


def _words() -> Column:
    """The words of the lower-cased text. Cutting at single spaces is many
    times faster than a search for words by a pattern."""
    return F.array_remove(F.split(F.translate(text_or_empty(), CAPITALS + _BETWEEN, SMALL + " " * len(_BETWEEN)), " "), "")


def _places(words: str) -> Column:
    """(at, label) of all places of the phrases. ``words`` is null for texts
    that hold none, which is most of them."""

    def at(i: Column, phrase: str) -> Column:
        found = F.lit(True)
        for n, x in enumerate(phrase.split()):
            found = found & (F.get(F.col(words), i + n) == x)
        return F.coalesce(found, F.lit(False))

    label = lambda i: F.coalesce(*(F.when(at(i, p), F.lit(x)) for p, x in PHRASES.items()))
    return F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.struct(i.cast("long").alias("at"), label(i).alias("label"))), lambda x: x["label"].isNotNull())


def _letters_of(hits: str, code: str) -> Column:
    """(pos, letter) of all words of a span that its hits account for, in order;
    hits that share a word agree on it and give it several times."""
    # each hit accounts for K words
    each = lambda h: F.flatten(F.transform(h["tpos"], lambda p: F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda k: F.struct((h["diagonal"] + p + k).alias("pos"), F.substring(F.col(code), p + k + 1, F.lit(1)).alias("letter")))))
    return F.sort_array(F.flatten(F.transform(hits, each)))


def _filled(letters: str) -> Column:
    """One letter per word from the first to the last of ``letters``."""
    before = lambda i: F.get(F.col(letters), i - 1)["pos"]
    gap = lambda x, i: F.array_repeat(F.lit(_STRANGE), (x["pos"] - before(i) - 1).cast("int"))
    none = F.array().cast("array<string>")
    return F.flatten(F.transform(letters, lambda x, i: F.when(i == 0, F.array(x["letter"])).when(x["pos"] == before(i), none).otherwise(F.concat(gap(x, i), F.array(x["letter"])))))


def _verified(hits: str, span: str, first: Column, code: str) -> Column:
    """(edits, first, last) of the best reading of a merged span: as a whole,
    or as far as the template reaches along one of its diagonals. ``span`` and
    what else is read in each step are columns of their own, so a reading costs
    what the template's length says, however long the span is."""
    length, last = F.char_length(code), first + F.size(span) - 1

    def reading(a: Column, b: Column) -> Column:
        part = F.array_join(F.transform(F.sequence(a, b), lambda p: F.get(F.col(span), (p - first).cast("int"))), "")
        # a reading that is far too long needs no comparison
        edits = F.when(b - a + 1 > 2 * length, b - a + 1).otherwise(F.levenshtein(part, F.col(code)))
        return F.struct(edits.cast("int").alias("edits"), a.alias("first"), b.alias("last"))

    along = F.transform(hits, lambda h: reading(F.greatest(h["diagonal"], first), F.least(h["diagonal"] + length - 1, last)))
    return F.array_min(F.concat(F.array(reading(first, last)), along))


def spans(docs: DataFrame, id_col: str = "doc_id", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Verified spans: ``id``, ``sig`` (hash of the text), ``template``,
    ``label``, ``first`` and ``last`` word, ``edits``, ``likeness`` (1 minus
    edits per word of the template). Null, empty and short texts have none;
    rows that repeat id and text share their spans. The work on a very long
    text grows with its words and hits, also where it repeats a phrase."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64("text").alias("sig"), _words().alias("w"))
    after = lambda n: F.slice("w", F.lit(n + 1), F.size("w")).alias(f"t{n}")
    rolling = rows.select("id", "sig", F.posexplode(F.arrays_zip(F.col("w").alias("t0"), *(after(n) for n in range(1, K)))).alias("pos", "g")).select("id", "sig", "pos", "g.*").where(f"t{K - 1} IS NOT NULL")
    same = F.col("h") == F.xxhash64(*(f"t{i}" for i in range(K)))
    for i in range(K):
        same = same & (F.col(f"t{i}") == F.col(f"w{i}"))
    hits = rolling.join(F.broadcast(template_table(docs.sparkSession, templates)), same).groupBy("id", "sig", "template", "label", "code", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("tpos"))
    by = W.partitionBy("id", "sig", "template")
    apart = hits.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(by.orderBy("diagonal")) > NEIGHBOURS).cast("int"))
    merged = apart.withColumn("span", F.sum(F.coalesce("new", F.lit(0))).over(by.orderBy("diagonal"))).groupBy("id", "sig", "template", "label", "code", "span")
    merged = merged.agg(F.collect_list(F.struct("diagonal", "tpos")).alias("hits")).withColumn("length", F.char_length("code"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.flatten("hits.tpos"), lambda p: F.sequence(p, p + K - 1)))))
    # a diagonal that holds the whole template needs no comparison
    exact = F.array_min(F.transform(F.filter("hits", lambda h: F.size(h["tpos"]) == F.col("length") - K + 1), lambda h: h["diagonal"]))
    voted = merged.where(VOTES * covered >= F.col("length")).withColumn("exact", exact)
    voted = voted.withColumn("letters", F.when(F.col("exact").isNull(), _letters_of("hits", "code")))
    voted = voted.withColumns({"filled": _filled("letters"), "start": F.get("letters", F.lit(0))["pos"]})
    # one row per group already: this keeps the filter on edits from working these columns out anew for every reading
    voted = voted.groupBy("id", "sig", "template", "label", "code", "span", "length").agg(*(F.first(c).alias(c) for c in ("hits", "exact", "filled", "start")))
    best = F.when(F.col("exact").isNotNull(), F.struct(F.lit(0).alias("edits"), F.col("exact").alias("first"), (F.col("exact") + F.col("length") - 1).alias("last"))).otherwise(_verified("hits", "filled", F.col("start"), "code"))
    found = voted.withColumn("best", best).where(EDITS * F.col("best.edits") <= F.col("length"))
    return found.select("id", "sig", "template", "label", F.col("best.first").alias("first"), F.col("best.last").alias("last"), F.col("best.edits").alias("edits"), (1 - F.col("best.edits") / F.col("length")).alias("likeness"))


def scan(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_base``,
    ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    The score is 1 where a phrase stands, else the best likeness of a verified
    span, 0 without any. A null text is an empty one: no words, no labels,
    score 0. Repeated rows are scanned each by themselves. Other columns are
    ignored.
    """
    found = spans(docs, id_col).groupBy("id", "sig").agg(F.collect_set("label").alias("found"), F.max("likeness").alias("best"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64("text").alias("sig"), _words().alias("w"), F.rlike(text_or_empty(), F.lit("(?i)" + "|".join(_GAP.join(p.split()) for p in PHRASES))).alias("seen"))
    rows = rows.select("id", "sig", F.size("w").cast("long").alias("n_words"), F.when(F.col("seen"), F.col("w")).alias("ws"))
    rows = rows.select("id", "sig", "n_words", F.when(F.col("ws").isNotNull(), _places("ws")).alias("p"))
    none = F.array().cast("array<string>")
    out = rows.select("id", "sig", "n_words", F.coalesce(F.size("p").cast("long"), F.lit(0).cast("long")).alias("n"), F.array_min("p.at").alias("first_word"), F.array_max("p.at").alias("last_word"), F.coalesce(F.array_distinct("p.label"), none).alias("b"))
    out = out.withColumn("n_base", F.greatest("n", F.lit(0).cast("long")))
    key = (F.col("id").eqNullSafe(F.col("f_id"))) & (F.col("sig") == F.col("f_sig"))
    out = out.join(found.select(F.col("id").alias("f_id"), F.col("sig").alias("f_sig"), "found", "best"), key, "left")
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("b"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("b", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.round(F.coalesce("best", F.lit(0.0)), 6)).alias("score"),
    )


def op6_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


_GRAMS = ", ".join("({}, {}, '{}', '{}', '{}')".format(n, p, label, code.replace("'", "''"), " ".join(w)) for n, p, label, code, *w in template_rows())
OP6_SQL = f"""
WITH t(template, tpos, label, code, gram) AS (VALUES {_GRAMS}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '{WORD}') AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS w1, generate_subscripts(ws, 1) - 1 AS pos FROM d),
g AS (SELECT rid, pos, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
b AS (SELECT rid, pos, CASE WHEN w1 = 'cc' AND w2 = 'by' THEN 'cc-by' WHEN w1 = 'general' AND w2 = 'public' AND w3 = 'license' THEN 'gpl'
             WHEN w1 = 'all' AND w2 = 'rights' AND w3 = 'reserved' THEN 'reserved' END AS label FROM g),
ba AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS b FROM b WHERE label IS NOT NULL GROUP BY rid),
h AS (SELECT rid, template, label, code, length(code) AS length, pos - tpos AS diagonal, tpos FROM g JOIN t ON t.gram = w1 || ' ' || w2 || ' ' || w3),
dg AS (SELECT rid, template, diagonal FROM h GROUP BY ALL),
st AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o > {NEIGHBOURS} THEN 1 ELSE 0 END AS new FROM dg WINDOW o AS (PARTITION BY rid, template ORDER BY diagonal)),
sp AS (SELECT *, sum(new) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span FROM st),
hs AS (SELECT h.*, span FROM h JOIN sp USING (rid, template, diagonal)),
cv AS (SELECT rid, template, span FROM hs, range(0, {K}) r(k) GROUP BY rid, template, span, length HAVING {VOTES} * count(DISTINCT tpos + k) >= length),
le AS (SELECT DISTINCT rid, template, span, code, diagonal + tpos + k AS pos, substr(code, (tpos + k + 1)::BIGINT, 1) AS letter FROM hs SEMI JOIN cv USING (rid, template, span), range(0, {K}) r(k)),
bo AS (SELECT rid, template, span, code, min(pos) AS first, max(pos) AS last FROM le GROUP BY ALL),
tx AS (SELECT p.rid, p.template, p.span, p.code, p.first, p.last, string_agg(coalesce(letter, '{_STRANGE}'), '' ORDER BY p.pos) AS t
       FROM (SELECT *, unnest(range(first, last + 1)) AS pos FROM bo) p LEFT JOIN le ON le.rid = p.rid AND le.template = p.template AND le.span = p.span AND le.pos = p.pos GROUP BY ALL),
rd AS (SELECT rid, template, span, code, t AS part FROM tx WHERE length(t) <= 2 * length(code) UNION ALL
       SELECT rid, template, span, code, substr(t, (greatest(diagonal, first) - first + 1)::BIGINT, (least(diagonal + length(code) - 1, last) - greatest(diagonal, first) + 1)::BIGINT) FROM tx JOIN sp USING (rid, template, span)),
ve AS (SELECT rid, template, span, length(code) AS length, min(levenshtein(part, code)) AS edits FROM rd GROUP BY ALL),
f AS (SELECT rid, list(DISTINCT label) AS f, max(1 - edits / length) AS best FROM ve JOIN (SELECT DISTINCT template, label FROM t) USING (template) WHERE {EDITS} * edits <= length GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(b), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b, []), coalesce(f, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE round(coalesce(best, 0), 6) END::DOUBLE AS score
FROM d LEFT JOIN ba USING (rid) LEFT JOIN f USING (rid)
"""
