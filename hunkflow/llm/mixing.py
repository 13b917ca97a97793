"""Mixing sources to target weights, with DataFrame operations only.

Source s holds t(s) tokens. Its weight is proportional to t(s) ** a for an
exponent a in [0, 1], found by bisection: the flattest mixture (smallest a)
that repeats no source more than the limit, or the steepest (largest a) that
reaches a target entropy. The budget is the least for which no source loses a
document: the largest source is read once, the others more often.

Weights become rows by budgeted block permutations. The documents of a source
are dealt into blocks of bounded expected size; every epoch orders the blocks
anew, and the last, partial epoch ends where the source's budget ends. An
order is a pair of hashes, so the end of the partial epoch is one point per
source and no document has to be moved to find out whether it lies before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ASCII_SPACE, WORD, free_name, join_small, materialise, table, text_or_empty

MAX_REPEATS = 2.0
BLOCK_DOCS = 512
CELLS = 1024  # of a source's block order, for prefix sums in two levels
STEPS = 50
FINENESS = 200  # buckets of the histogram of source sizes per factor e
NULL_SOURCE = "\x01"


def _hash(*parts: Column) -> Column:
    """60 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary")), 1, 15), 16, 10).cast("long")


def _doc_key(id_col: str) -> Column:
    """The text takes part, so that rows which share an id are dealt apart."""
    return _hash(F.lit("doc"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text_or_empty().cast("binary")))


def _block_key(epoch: Column, source: Column, block: Column) -> Column:
    return _hash(F.lit("block"), epoch, source, block)


def _tokens() -> Column:
    words = F.split(F.translate(text_or_empty(), ASCII_SPACE, " " * len(ASCII_SPACE)), " ")
    return F.size(F.array_remove(words, "")).cast("long")


def _source(df: DataFrame) -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(NULL_SOURCE)) if "source" in df.columns else F.lit(NULL_SOURCE)


def exponent(sources: DataFrame, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None) -> DataFrame:
    """One row: ``a`` and the largest source's ``t_max``. ``sources`` has a
    row per source with its tokens ``t``. ``target_entropy`` is a share of the
    greatest possible entropy; if given, it decides instead of the limit.

    What is searched on are two numbers for the limit, and for the entropy a
    histogram of the sources' sizes: ``FINENESS`` buckets per factor e, each
    with its sources' number and mean, so under 9,000 however many sources."""
    full = sources.where("t > 0")
    mid = "(s.lo + s.hi) / 2"
    if target_entropy is None:  # too flat: the smallest source repeats too often
        one = full.agg(F.min("t").cast("double").alias("t_min"), F.max("t").cast("double").alias("t_max")).where("t_max IS NOT NULL")
        flat = f"pow(t_max / t_min, 1 - {mid}) > {max_repeats!r}D"
    else:  # flat enough to lower the weight of small sources: H = ln Z - sum(w ln w) / Z
        buckets = full.groupBy(F.floor(F.log("t") * FINENESS).alias("bucket")).agg(F.count("*").cast("double").alias("n"), F.avg("t").alias("t"))
        one = buckets.agg(F.sort_array(F.collect_list(F.struct("t", "n"))).alias("ts"), F.max("t").alias("t_max"), F.sum("n").alias("n")).where("t_max IS NOT NULL")
        z = f"aggregate(ts, 0D, (z, x) -> z + x.n * pow(x.t / t_max, {mid}))"
        h = f"(ln({z}) - aggregate(ts, 0D, (e, x) -> e + x.n * pow(x.t / t_max, {mid}) * {mid} * ln(x.t / t_max)) / {z})"
        flat = f"{h} >= {target_entropy!r}D * ln(n)"
    search = f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (s, i) -> if({flat}, named_struct('lo', {mid}, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {mid})))"
    end = "hi" if target_entropy is None else "lo"
    edge = F.ceil if target_entropy is None else F.floor
    return one.select((edge(F.expr(f"{search}.{end}") * 1e6) / 1e6).alias("a"), "t_max")


def plan(rows: DataFrame, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None) -> DataFrame:
    """One row per source: ``k`` (source), ``epochs`` read in full, ``blocks``,
    and ``cut``, the order key of the last document of the partial epoch (null
    if it is empty). ``rows`` has ``k``, ``key`` (document hash), ``t``."""
    sources = materialise(rows.groupBy("k").agg(F.sum("t").alias("t"), F.count("*").alias("n")))
    found = exponent(sources, max_repeats, target_entropy).first()  # two numbers, or none without tokens
    a, t_max = (float(found.a), float(found.t_max)) if found else (1.0, 1.0)
    repeats = F.when(F.col("t") > 0, F.pow(F.lit(t_max) / F.col("t"), F.lit(1.0) - F.lit(a))).otherwise(1.0)
    budgets = materialise(
        sources.withColumn("budget", F.floor(F.round(repeats * F.col("t"), 3)).cast("long"))
        .select("k", F.when(F.col("t") > 0, F.expr("budget div t")).otherwise(1).cast("long").alias("epochs"), F.when(F.col("t") > 0, F.expr("budget % t")).otherwise(0).alias("rest"), F.ceil(F.col("n") / BLOCK_DOCS).cast("long").alias("blocks"))
    )
    last = F.col("epochs") + 1
    dealt = join_small(rows, budgets.where("rest > 0"), ["k"]).withColumn("block", F.col("key") % F.col("blocks"))
    blocks = dealt.groupBy("k", "block", "epochs", "rest").agg(F.sum("t").alias("bt")).withColumn("bkey", _block_key(last, F.col("k"), F.col("block")))
    blocks = blocks.withColumn("cell", F.expr(f"bkey div {(1 << 60) // CELLS}"))
    cells = blocks.groupBy("k", "cell").agg(F.sum("bt").alias("ct"))
    cells = cells.select("k", "cell", F.coalesce(F.sum("ct").over(W.partitionBy("k").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("cell_start"))
    inner = F.coalesce(F.sum("bt").over(W.partitionBy("k", "cell").orderBy("bkey", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("inner", inner).join(cells, ["k", "cell"]).select("k", "block", "bkey", (F.col("inner") + F.col("cell_start")).alias("start"), "rest")
    open_blocks = starts.where("start <= rest")
    # rows that repeat id and text are read together or not at all: a window sees them as one
    alike = dealt.groupBy("k", "block", "key", "id").agg(F.sum("t").alias("t"))
    cum = F.sum("t").over(W.partitionBy("k", "block").orderBy("key", "id").rowsBetween(W.unboundedPreceding, 0))
    taken = alike.withColumn("cum", cum).join(open_blocks, ["k", "block"]).where("start + cum <= rest")
    cuts = taken.groupBy("k").agg(F.max(F.struct("bkey", "block", "key", "id")).alias("cut"))
    return materialise(budgets.select("k", "epochs", "blocks").join(cuts, "k", "left"))


def _epochs(key: str, k: str, id_col: str, plan_: str = "") -> Column:
    """The epochs in which a document is read."""
    epochs, blocks, cut = (F.col(plan_ + c) for c in ("epochs", "blocks", "cut"))
    block = F.col(key) % blocks
    own = F.struct(_block_key(epochs + 1, F.col(k), block).alias("bkey"), block.alias("block"), F.col(key).alias("key"), F.col(id_col).cast("long").alias("id"))
    full = F.when(epochs > 0, F.sequence(F.lit(1).cast("long"), epochs)).otherwise(F.array().cast("array<bigint>"))
    return F.when(cut.isNotNull() & (own <= cut), F.concat(full, F.array(epochs + 1))).otherwise(full)


def slim(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), _source(docs).alias("k"), _doc_key(id_col).alias("key"), _tokens().alias("t"))


def mix(docs: DataFrame, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None, id_col: str = "doc_id") -> DataFrame:
    """One row per document and epoch: ``doc_id``, ``source``, ``n_tokens``,
    ``epoch`` (from 1), ``block_key``, ``doc_key``. Read in the order of
    (source, epoch, block_key, doc_key) this is the source's permutation.

    Tokens are words between white space; a null text has none. A null source
    is a source of its own. A source without tokens is read once. Rows that
    repeat id and text are read equally often. With one source nothing
    repeats; an empty table gives no rows; columns of any name may be there
    beside id, text and source.
    """
    rows = materialise(slim(docs, id_col))
    placed = join_small(rows, plan(rows, max_repeats, target_entropy), ["k"]).withColumn("epoch", F.explode(_epochs("key", "k", "id")))
    return placed.select(
        F.col("id").alias("doc_id"),
        F.expr("nullif(k, '\\u0001')").alias("source"),
        F.col("t").alias("n_tokens"),
        "epoch",
        _block_key(F.col("epoch"), F.col("k"), F.col("key") % F.col("blocks")).alias("block_key"),
        F.col("key").alias("doc_key"),
    )


def repeat_documents(docs: DataFrame, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None, id_col: str = "doc_id") -> DataFrame:
    """The documents with all their columns, each as often as ``mix`` reads it,
    which also says what becomes of nulls, repeated rows and empty tables."""
    k, key, epoch = (free_name(docs, n) for n in ("_k", "_key", "_epoch"))
    rows = materialise(slim(docs, id_col))
    own = free_name(docs, "_plan")
    plan_ = plan(rows, max_repeats, target_entropy).select(F.col("k").alias(k), F.struct("epochs", "blocks", "cut").alias(own))
    placed = join_small(docs.withColumns({k: _source(docs), key: _doc_key(id_col)}), plan_, [k])
    return placed.withColumn(epoch, F.explode(_epochs(key, k, id_col, own + "."))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


def mixed_sql(source: str) -> str:
    """CTEs over ``source``: ``mixed`` has a row per document and epoch."""
    h = lambda *p: f"('0x' || substr(md5(concat_ws('|', {', '.join(p)})), 1, 15))::BIGINT"
    return f"""
s7 AS (SELECT *, doc_id AS id, coalesce(source, chr(1)) AS k, {h("'doc'", "coalesce(doc_id::VARCHAR, '')", "md5(coalesce(text, ''))")} AS key,
              len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS t FROM {source}),
so7 AS (SELECT k, sum(t)::BIGINT AS t, count(*) AS n FROM s7 GROUP BY k),
mm7 AS (SELECT max(t)::DOUBLE AS t_max, min(t)::DOUBLE AS t_min FROM so7 WHERE t > 0),
bis7(i, lo, hi) AS (SELECT 0, 0::DOUBLE, 1::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN pow(t_max / t_min, 1 - (lo + hi) / 2) > {MAX_REPEATS} THEN (lo + hi) / 2 ELSE lo END,
                CASE WHEN pow(t_max / t_min, 1 - (lo + hi) / 2) > {MAX_REPEATS} THEN hi ELSE (lo + hi) / 2 END FROM bis7, mm7 WHERE i < {STEPS}),
a7 AS (SELECT ceil(hi * 1e6) / 1e6 AS a, t_max FROM bis7, mm7 WHERE i = {STEPS}),
bu7 AS (SELECT k, t, n, CASE WHEN t > 0 THEN floor(round(pow(t_max / t, 1 - a) * t, 3))::BIGINT ELSE 0 END AS budget, ceil(n / {BLOCK_DOCS})::BIGINT AS blocks FROM so7 LEFT JOIN a7 ON true),
pl7 AS (SELECT k, blocks, CASE WHEN t > 0 THEN budget // t ELSE 1 END AS epochs, CASE WHEN t > 0 THEN budget % t ELSE 0 END AS rest FROM bu7),
de7 AS (SELECT s7.*, blocks, epochs, rest, key % blocks AS block, {h("'block'", "(epochs + 1)::VARCHAR", "k", "(key % blocks)::VARCHAR")} AS bkey FROM s7 JOIN pl7 USING (k)),
cu7 AS (SELECT *, sum(t) OVER (PARTITION BY k ORDER BY bkey, block, key, id RANGE UNBOUNDED PRECEDING) AS cum FROM de7),
mixed AS (SELECT *, unnest(range(1, (epochs + CASE WHEN rest > 0 AND cum <= rest THEN 1 ELSE 0 END + 1)::BIGINT)) AS epoch FROM cu7)"""


OP7_SQL = f"""WITH RECURSIVE {mixed_sql('documents')}
SELECT doc_id, source, t AS n_tokens, epoch, ('0x' || substr(md5(concat_ws('|', 'block', epoch::VARCHAR, k, block::VARCHAR)), 1, 15))::BIGINT AS block_key, key AS doc_key FROM mixed"""
