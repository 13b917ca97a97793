"""Quality rules whose thresholds come from quantile sketches.

Each text is measured once. Per language and source, every measure gets a
DDSketch (counts of logarithmic buckets): sketches of the same measure merge
by adding counts, so they build up map-side, and the sketch of a language or
of the whole corpus is the sum of those below it. A threshold is a fence at
some spreads from two quantiles of its own group's sketch; documents outside
any fence are rejected.

Most documents of a group often have none of what a rule counts, so that both
quantiles are 0. A fence is therefore at least as wide as ``EVENTS`` counted
things in a document of the group's lower quartile of size: a rate in a text
is known no better than that. This width, too, is read from the sketches.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, free_name, join_small, materialise, modest_batches, table

ACCURACY = 0.01  # relative error of a sketch's quantiles
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
LEAST_ROWS = 200  # a smaller group takes its language's sketch, a smaller language the corpus's
EVENTS = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


class Rule(NamedTuple):
    top: str
    under: str
    scale: int  # a measure is scale * top div under
    inner: float  # the quantiles whose distance is a spread
    outer: float
    spreads: float  # how far beyond the outer quantile the fence stands
    size: str | None  # what the least width refers to
    both: bool = False  # also a lower fence, as far below the inner quantile


RULES = {
    "symbols": Rule("n_symbols", "word_chars", 1000, 0.25, 0.75, 3.0, "word_chars"),
    "dup_lines": Rule("n_dup_lines", "n_lines", 1000, 0.75, 0.9, 3.0, "n_lines"),
    "repeats": Rule("n_repeat_words", "n_words", 1000, 0.75, 0.9, 6.0, "n_words"),
    "capitals": Rule("n_capitals", "word_chars", 1000, 0.25, 0.75, 5.0, "word_chars"),
    "word_length": Rule("word_chars", "n_words", 100, 0.25, 0.75, 6.0, None, True),
}
MEASURES = tuple(RULES)
SIZES = ("n_words", "n_lines", "word_chars")
QUANTILES = (0.25, 0.75, 0.9)
LIMITS = tuple(f"{side}_{m}" for m, r in RULES.items() for side in (("min", "max") if r.both else ("max",)))

_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]
FEATURES = T.StructType([T.StructField(n, T.LongType()) for n in _NAMES])
_CAPITALS = bytes(range(65, 91))
_NOT_CAPITAL = bytes(set(range(256)) - set(_CAPITALS))


def _repeated(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    v = len(ids)
    if v == len(words):
        return 0
    if v < 2_000_000:
        keys = (a[:-2] * v + a[1:-1]) * v + a[2:]
    else:
        _, pairs = np.unique(a[:-2] * v + a[1:-1], return_inverse=True)
        keys = pairs * v + a[2:]
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : len(keys) + i] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The columns of ``FEATURES`` for one text; null counts as empty."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    word_bytes = sum(map(len, words))
    lines = [x for x in b.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(text or "") - (len(b) - word_bytes),
        len(b) - len(b.translate(None, b"#*$%&|<>")),
        len(lines) - len(set(lines)),
        _repeated(words),
        len(lines),
        len(b.translate(None, _NOT_CAPITAL)),
    )


@F.arrow_udf(FEATURES)
def _measured(texts: pa.Array) -> pa.Array:
    rows = np.array([measure(t.as_py()) for t in texts], np.int64).reshape(-1, len(_NAMES))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(_NAMES))], _NAMES)


def _rate(measure_name: str, f: str) -> Column:
    r = RULES[measure_name]
    return F.expr(f"{r.scale} * {f}.{r.top} div greatest({f}.{r.under}, 1)")


def _sketched(f: str) -> list[Column]:
    """What the sketches are made of: the rules' rates and the sizes."""
    return [*(_rate(m, f).alias(m) for m in MEASURES), *(F.col(f"{f}.{n}").alias(n) for n in SIZES)]


def _keys(df: DataFrame) -> dict[str, Column]:
    """Group columns; a missing column or a null is a value of its own."""
    return {c: F.coalesce(F.col(c).cast("string"), F.lit("\x00")) if c in df.columns else F.lit("\x00") for c in ("lang", "source")}


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n); bucket is null for the value 0."""
    pairs = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in (*MEASURES, *SIZES)))
    rows = measured.select("lang", "source", F.explode(pairs).alias("p")).select("lang", "source", "p.measure", "p.x")
    bucket = F.when(F.col("x") > 0, F.ceil(F.log("x") / F.lit(math.log(GAMMA))))
    return rows.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def _q(q: float) -> str:
    return f"q{round(100 * q)}"


def _quantiles(counts: DataFrame, *by: str) -> DataFrame:
    """Rows and ``QUANTILES`` of each merged sketch. A sketch is one small
    array: its buckets are bounded by the range of the measure."""
    merged = counts.groupBy(*by, "measure", F.coalesce("bucket", F.lit(-(1 << 30))).alias("bucket")).agg(F.sum("n").alias("n"))
    folded = merged.groupBy(*by, "measure").agg(F.sum("n").alias("rows"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("s"))

    def value(q: float) -> Column:
        found = F.expr(
            f"aggregate(s, named_struct('c', 0L, 'b', cast(null as bigint)), (a, x) -> named_struct('c', a.c + x.n, "
            f"'b', if(a.b is null and a.c + x.n > floor({q} * (rows - 1)), cast(x.bucket as bigint), a.b))).b"
        )
        return F.when(found > -(1 << 30), 2 * F.pow(F.lit(GAMMA), found) / (GAMMA + 1)).otherwise(0.0)

    return folded.select(*by, "measure", "rows", *(value(q).alias(_q(q)) for q in QUANTILES))


def thresholds(counts: DataFrame) -> DataFrame:
    """One row per (lang, source): the columns ``LIMITS``, all read from the
    sketch of the group, or of its language or the corpus if it is too small."""
    names = [_q(q) for q in QUANTILES]
    own = _quantiles(counts, "lang", "source")
    by_lang = _quantiles(counts, "lang").select("lang", "measure", *(F.col(c).alias(f"l_{c}") for c in ("rows", *names)))
    whole = _quantiles(counts).select("measure", *(F.col(c).alias(f"w_{c}") for c in names))

    def pick(c: str) -> Column:
        return F.when(F.col("rows") >= LEAST_ROWS, F.col(c)).when(F.col("l_rows") >= LEAST_ROWS, F.col(f"l_{c}")).otherwise(F.col(f"w_{c}"))

    rows = own.join(by_lang, ["lang", "measure"]).join(whole, "measure").select("lang", "source", "measure", *(pick(c).alias(c) for c in names))
    wide = rows.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}") for m in (*MEASURES, *SIZES) for c in names))
    limits = []
    for m, r in RULES.items():
        inner, outer = F.col(f"{m}_{_q(r.inner)}"), F.col(f"{m}_{_q(r.outer)}")
        width = r.spreads * (outer - inner)
        if r.size:
            width = F.greatest(width, F.lit(float(r.scale * EVENTS)) / F.greatest(F.col(f"{r.size}_q25"), F.lit(1.0)))
        limits += [(inner - width).alias(f"min_{m}")] if r.both else []
        limits.append((outer + width).alias(f"max_{m}"))
    return wide.select("lang", "source", *limits)


def _base_failed(f: str) -> Column:
    return F.expr(f"{f}.n_words < {MIN_WORDS} OR 100 * {f}.n_repeat_words > {MAX_REPEAT_PERCENT} * {f}.n_words")


def _within(value: Callable[[str], Column], limit: Callable[[str], Column]) -> Column:
    sides = [value(c[4:]) <= limit(c) if c.startswith("max") else value(c[4:]) >= limit(c) for c in LIMITS]
    return reduce(Column.__and__, sides)


def judge(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``id_col``, the base measures, ``base_failed``,
    ``kept``, the measures and the limits that were applied.

    A null text is measured as an empty one and fails the base rules. A null
    language or source forms a group. A value equal to its threshold passes.
    Repeated rows are judged separately; an empty table gives no rows.
    """
    modest_batches(docs)
    # the measure runs once: what is written is a few numbers per document
    measured = docs.select(F.col(id_col).alias("id"), *(c.alias(n) for n, c in _keys(docs).items()), _measured("text").alias("f"))
    measured = materialise(measured.select("id", "lang", "source", "f", *_sketched("f"), _base_failed("f").alias("base_failed")))
    out = join_small(measured, materialise(thresholds(sketches(measured))), ["lang", "source"])
    kept = ~F.col("base_failed") & _within(F.col, F.col)
    return out.select(F.col("id").alias(id_col), *(f"f.{n}" for n in _NAMES[:5]), "base_failed", kept.alias("kept"), *MEASURES, *(F.round(c, 6).alias(c) for c in LIMITS))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns. Texts are
    measured a second time here, which costs less than moving them to join a
    verdict. Null and empty texts fail the base rules and go; repeated rows
    stay or go together; an empty table gives no rows; columns of any name may
    be there beside text, lang and source."""
    modest_batches(docs)
    f, key = free_name(docs, "_measured"), {n: free_name(docs, f"_{n}") for n in ("lang", "source")}
    measured = docs.select(*(c.alias(n) for n, c in _keys(docs).items()), _measured("text").alias("f"))
    counts = materialise(sketches(measured.select("lang", "source", *_sketched("f"))))
    limits = materialise(thresholds(counts)).select(*(F.col(n).alias(k) for n, k in key.items()), F.struct(*LIMITS).alias(free_name(docs, "_limits")))
    limit = limits.columns[-1]
    rows = docs.withColumns({f: _measured("text")} | {k: _keys(docs)[n] for n, k in key.items()})
    rows = join_small(rows, limits, list(key.values()))
    within = ~_base_failed(f) & _within(lambda m: _rate(m, f), lambda c: F.col(f"{limit}.{c}"))
    return rows.where(within).select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))


def kept_sql(source: str) -> str:
    """CTEs over the table ``source``: ``judged`` has op2's rows."""
    rates = ", ".join(f"({r.scale} * {r.top} // greatest({r.under}, 1))::BIGINT AS {m}" for m, r in RULES.items())
    names = [_q(q) for q in QUANTILES]
    value = lambda q: f"min(CASE WHEN cum > floor({q} * (total - 1)) THEN bucket END)"
    val = lambda b: f"CASE WHEN {b} > -1000000 THEN 2 * pow({GAMMA!r}::DOUBLE, {b}) / ({GAMMA!r}::DOUBLE + 1) ELSE 0 END"

    def merged(by: str) -> str:
        return (
            f"(SELECT {by}measure, rows, {', '.join(f'{val(c)} AS {c}' for c in names)} FROM (SELECT {by}measure, max(total) AS rows, {', '.join(f'{value(q)} AS {_q(q)}' for q in QUANTILES)} FROM "
            f"(SELECT {by}measure, bucket, sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY {by}measure) AS total FROM "
            f"(SELECT {by}measure, bucket, sum(n) AS n FROM sk GROUP BY ALL)) GROUP BY ALL))"
        )

    limits = []
    for m, r in RULES.items():
        inner, outer = f"{m}_{_q(r.inner)}", f"{m}_{_q(r.outer)}"
        width = f"{r.spreads}::DOUBLE * ({outer} - {inner})"
        if r.size:
            width = f"greatest({width}, {float(r.scale * EVENTS)}::DOUBLE / greatest({r.size}_q25, 1))"
        limits += [f"{inner} - {width} AS min_{m}"] if r.both else []
        limits.append(f"{outer} + {width} AS max_{m}")
    inside = " AND ".join(f"{c[4:]} {'<=' if c.startswith('max') else '>='} {c}" for c in LIMITS)
    return f"""
src AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce(lang, chr(1)) AS lang, coalesce(source, chr(1)) AS source FROM {source}),
wl AS (SELECT rid, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
              list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM src),
wd AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM wl),
tri AS (SELECT rid, i, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM wd WINDOW p AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i FROM tri WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, w, w2, w3) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(0, 3) r(k) GROUP BY rid),
m AS (SELECT src.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(ls)::BIGINT AS n_lines, length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS n_capitals
      FROM src JOIN wl USING (rid) LEFT JOIN cov USING (rid)),
mm AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {rates} FROM m),
u AS (UNPIVOT (SELECT lang, source, {', '.join((*MEASURES, *SIZES))} FROM mm) ON {', '.join((*MEASURES, *SIZES))} INTO NAME measure VALUE x),
sk AS (SELECT lang, source, measure, CASE WHEN x > 0 THEN ceil(ln(x) / {math.log(GAMMA)!r}::DOUBLE)::BIGINT ELSE -(1 << 30)::BIGINT END AS bucket, count(*) AS n FROM u GROUP BY ALL),
pk AS (SELECT o.lang, o.source, o.measure, {', '.join(f'CASE WHEN o.rows >= {LEAST_ROWS} THEN o.{c} WHEN l.rows >= {LEAST_ROWS} THEN l.{c} ELSE w.{c} END AS {c}' for c in names)}
       FROM {merged('lang, source, ')} o JOIN {merged('lang, ')} l ON l.lang = o.lang AND l.measure = o.measure JOIN {merged('')} w ON w.measure = o.measure),
wi AS (SELECT lang, source, {', '.join(f"max({c}) FILTER (measure = '{k}') AS {k}_{c}" for k in (*MEASURES, *SIZES) for c in names)} FROM pk GROUP BY lang, source),
limits AS (SELECT lang, source, {', '.join(limits)} FROM wi),
judged AS (SELECT mm.rid, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
                  NOT base_failed AND {inside} AS kept, {', '.join(MEASURES)}, {', '.join(LIMITS)}
           FROM mm JOIN limits USING (lang, source))"""


OP2_SQL = f"WITH {kept_sql('documents')} SELECT * EXCLUDE (rid, {', '.join(LIMITS)}), {', '.join(f'round({c}, 6) AS {c}' for c in LIMITS)} FROM judged"
