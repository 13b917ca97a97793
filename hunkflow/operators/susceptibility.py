"""D10: how easily a large change of tests survives mutations of the code.

The added lines of a hunk are cut into blocks: a block begins at a line that
looks like a function or a test and ends with the first line that is indented
less. Windows over the hunk say which block a line belongs to, sums per block
and per hunk give the five factors of the score. Only hunks with ``LEAST_LINES``
or more added lines are looked at, and only their lines move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rules as R
from ..functions import text as T
from ..sources.tables import stored

LEAST_LINES, SMALL_LINES = 50, 80
HIGH, MEDIUM = 65, 45
KEYS = ("scan_id", "file_idx", "hunk_idx")
HUNK = (*KEYS, "path", "importance")


def added_lines(lines: DataFrame, least: int) -> DataFrame:
    """The added lines of test files' large hunks, numbered from 1 (``n``), with
    ``indent`` (-1 on blank lines) and what the rules say about each."""
    hunk = W.partitionBy(*KEYS)
    some = lines.where("is_test AND NOT non_functional AND path <> '/dev/null' AND marker = '+' AND raw NOT LIKE '+++%'")
    some = some.select(*HUNK, "lang", "line_idx", "body")  # what is sorted, once
    ordered = hunk.orderBy("line_idx")
    total = F.count("*").over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    some = some.withColumns({"n": F.row_number().over(ordered), "total": total}).where(F.col("total") >= least)
    body, lang = F.col("body"), F.col("lang")
    by = lambda table: F.coalesce(T.by_language(lang, table, lambda p: T.matches(body, p)), F.lit(False))
    function = by(R.FUNCTION_START)
    return some.select(
        *HUNK, "n", "total", T.indent(body).alias("indent"),
        function.alias("function"), (function | by(R.TEST_START)).alias("start"),
        (by(R.REGISTRY_ASSERTION) | T.matches(body, R.LOOSE_ASSERTION)).alias("asserts"), T.matches(body, R.NEGATIVE).alias("negative"), by(R.MOCKS).alias("mock"),
        T.matches(body, R.GENERIC).alias("generic"), T.matches(body, R.EMPTY_CATCH_LINE).alias("empty_catch"),
        T.matches(body, R.CONDITIONAL).alias("conditional"), T.matches(body, R.NEARBY_ASSERTION).alias("nearby"),
        (T.trim(body).isin("}", "end") | T.matches(body, r"^\s*\)\s*;")).alias("ends"),
    )


def _blocks(added: DataFrame) -> DataFrame:
    """One row per block (``block`` 0: before the first) of each hunk."""
    hunk = W.partitionBy(*KEYS)
    marked = added.withColumn("block", F.sum(F.col("start").cast("int")).over(hunk.orderBy("n")))
    own = W.partitionBy(*KEYS, "block")
    marked = marked.withColumn("base", F.max(F.when(F.col("start"), F.col("indent"))).over(own))
    closer = ~F.col("start") & (F.col("indent") >= 0) & (F.col("indent") < F.col("base"))
    ended = F.coalesce(F.max(closer.cast("int")).over(own.orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 1
    marked = marked.withColumn("inside", (F.col("block") > 0) & ~ended)
    within = lambda c: F.col("inside") & ~F.col("start") & F.col(c)
    real = F.col("block") > 0
    return marked.groupBy(*HUNK, "total", "block").agg(
        F.max((real & F.col("start") & F.col("function")).cast("int")).alias("function"), F.count_if(within("asserts")).alias("asserts"), F.max(within("negative").cast("int")).alias("negative"), F.max(within("mock").cast("int")).alias("mock"),
        F.count_if("generic").alias("generic"), F.count_if("empty_catch").alias("empty_catches"), F.min(F.when(F.col("inside"), F.col("n"))).alias("first"), F.max(F.when(F.col("inside"), F.col("n"))).alias("last"),
    )


def _gaps(added: DataFrame) -> DataFrame:
    """D10g: (hunk, gaps, gap): conditions without an assertion up to the end of
    their block or the next condition, and the text of the first."""
    hunk = W.partitionBy(*KEYS)
    cut = added.withColumn("part", F.sum(F.col("conditional").cast("int")).over(hunk.orderBy("n"))).where("part > 0")
    own = W.partitionBy(*KEYS, "part").orderBy("n")
    over = F.coalesce(F.max(F.col("ends").cast("int")).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 1
    parts = cut.withColumn("live", ~over).groupBy(*KEYS, "part").agg(F.min("n").alias("at"), F.max((F.col("live") & F.col("nearby")).cast("int")).alias("asserted"), F.min(F.when(F.col("live") & F.col("ends"), F.col("n"))).alias("end"))
    number = lambda c: F.col(c).cast("string")
    text = F.when(F.col("end").isNull(), F.concat(F.lit("Conditional at line "), number("at"), F.lit(" has no nearby assertion"))).otherwise(F.concat(F.lit("Conditional at line "), number("at"), F.lit(":"), number("end"), F.lit(" has no assertion")))
    return parts.where("asserted = 0").groupBy(*KEYS).agg(F.count("*").alias("gaps"), F.min_by(text, "at").alias("gap"))


def susceptible_hunks(lines: DataFrame, least: int = LEAST_LINES) -> DataFrame:
    """One row per hunk of test code with at least ``least`` added lines:
    ``score``, what it is made of, and ``confidence`` (none below 45)."""
    added = stored(added_lines(lines, least))  # few; blocks and gaps both read them
    hunks = _blocks(added).groupBy(*HUNK, F.col("total").alias("added")).agg(
        F.count_if(F.col("block") > 0).alias("blocks"), F.sum("function").alias("functions"), F.sum("asserts").alias("assertions"), F.sum("negative").alias("negatives"),
        F.sum("mock").alias("mocks"), F.sum("generic").alias("generics"), F.sum("empty_catches").alias("empty_catches"), F.coalesce(F.min("first"), F.lit(1)).alias("line_start"), F.max("last").alias("last"),
    )
    n, density = F.col("added"), F.col("assertions") * 100 / F.col("added")
    least_density, weight = F.when(n < SMALL_LINES, 1.0).otherwise(2.0), F.when(n < SMALL_LINES, 15).otherwise(30)
    functions = F.greatest(F.col("functions"), F.lit(1))
    each = F.col("assertions") / functions
    points: list[Column] = [
        F.when(density < least_density, T.round_half_up(weight * (1 - density / least_density))).otherwise(0),
        F.when((n >= SMALL_LINES) & (F.col("negatives") == 0) & (F.col("blocks") > 0), 25).otherwise(0),
        T.round_half_up(20 * F.col("generics") / F.greatest(F.col("assertions"), F.lit(1))),
        T.round_half_up(15 * F.least(F.col("mocks") / functions, F.lit(1.0))),
        F.when(each < 2, T.round_half_up(10 * (1 - each / 2))).otherwise(0),
    ]
    score = F.least(F.lit(100), sum(points[1:], points[0])).cast("int")
    level = F.when(F.col("score") >= HIGH, "high").when(F.col("score") >= MEDIUM, "medium").otherwise("none")
    tenths = T.round_half_up(density * 10).cast("long")
    shown = F.concat(F.expr("cast(tenths div 10 as string)"), F.when(F.col("tenths") % 10 > 0, F.concat(F.lit("."), (F.col("tenths") % 10).cast("string"))).otherwise(""))
    part = lambda name, c: F.concat(F.lit(name + ": "), F.col(c).cast("string"))
    evidence = F.concat_ws(
        "\n",
        F.concat(F.lit("Vulnerability Score: "), F.col("score").cast("string"), F.lit("/100")),
        F.concat(F.lit("Assertion Density: "), shown, F.lit(" per 100 lines (threshold: 2)")),
        part("Generic Matchers", "generics"), part("Negative Assertions", "negatives"), part("Mock Usage", "mocks"), part("Functions", "blocks"), part("Coverage Gaps", "gap"),
        F.when(F.col("gaps") > 1, F.concat(F.lit("  +"), (F.col("gaps") - 1).cast("string"), F.lit(" more gap(s)"))),
        F.when(F.col("empty_catches") > 0, F.concat(F.lit("Empty Catch Blocks: "), F.col("empty_catches").cast("string"), F.lit(" (mutations in try will survive)"))),
    )
    scored = hunks.join(_gaps(added), list(KEYS), "left").withColumns({"score": score, "tenths": tenths, "line_end": F.coalesce("last", "added")})
    return scored.select(*HUNK, *(F.col(c).cast("int").alias(c) for c in ("added", "blocks", "functions", "assertions", "negatives", "mocks", "generics", "line_start", "line_end")), F.coalesce("gaps", F.lit(0)).cast("int").alias("gaps"), "score", level.alias("confidence"), evidence.alias("evidence"))


def found(lines: DataFrame, least: int = LEAST_LINES) -> DataFrame:
    """The hunks that count, as the detectors give their findings."""
    det = R.DETECTORS.index("mutation_susceptibility")
    zero = lambda c: F.lit(0).alias(c)
    return susceptible_hunks(lines, least).where("confidence <> 'none'").select(
        "scan_id", F.lit(det).alias("det"), "file_idx", "hunk_idx", zero("phase"), zero("i1"), zero("i2"), F.lit("mutation_susceptibility").alias("pattern_type"),
        "path", "line_start", "line_end", "confidence", F.lit("susceptible").alias("kind"), "evidence", "importance",
    )
