"""Scoring in stages, with answers of a model between them.

Every stage takes the findings of the one before as they are: a judge's verdicts
drop or weaken some, what a model finds in the diff is appended, and so is what
slower rules find. Nothing is deduplicated again. Only change sets whose findings
a stage changed are scored anew, and what is appended last is listed but no longer
counts.

A model is a function from a table of requests to a table of answers. Answers
are kept in a table that only grows, under the hash of what was asked, so the
same request is asked once, in whatever change set or run it comes up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import rules as R
from ..functions import text
from . import scoring

MOST_DIFF = 8000  # characters of a diff that a model is shown
CUT = "\n... [truncated]"
Ask = Callable[[DataFrame], DataFrame]
ANSWERS = "hash string, answer string"
# fixed values: the fields of an answer, patterns that speak of tests, and defaults of a finding
ANALYSIS = T.StructType([
    T.StructField("hasCheating", T.BooleanType()),
    T.StructField("findings", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("pattern", "severity", "explanation", "filePath")] + [T.StructField(c, T.IntegerType()) for c in ("lineStart", "lineEnd")]))),
])
ABOUT_TESTS = ["coverage_reduction", "assertion_weakening", "test_silencing", "test_logic_bypass"]
SOFTENED = "semantic_bypass"
TEST_FILES = r"(?i)(\.(test|spec)\.(ts|tsx|js|jsx)$)|(_test\.go$)|(/(?:__tests__|tests?|fixtures)/)"
LINES_APART, LINES_LONG = 5, 3


def answered(requests: DataFrame, path: str, ask: Ask) -> DataFrame:
    """``requests`` (with a column ``request``) and ``answer``. What the table at
    ``path`` doesn't hold is asked and appended, each different request once."""
    spark = requests.sparkSession
    keyed = requests.withColumn("hash", F.sha2(F.col("request").cast("binary"), 256))
    asked = keyed.select("hash", "request").dropDuplicates(["hash"]).where("hash IS NOT NULL")
    if _exists(spark, path):
        asked = asked.join(spark.read.schema(ANSWERS).parquet(path), "hash", "left_anti")
    ask(asked).select("hash", F.col("answer").cast("string").alias("answer")).write.mode("append").parquet(path)
    spark.catalog.refreshByPath(path)
    # an answer may stand twice after a run that was repeated
    return keyed.join(spark.read.schema(ANSWERS).parquet(path).groupBy("hash").agg(F.min("answer").alias("answer")), "hash", "left").drop("hash")


def _exists(spark, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def judge_requests(deduped: DataFrame) -> DataFrame:
    """Deduplicated findings, each with what a judge is asked about it."""
    return deduped.withColumn("request", F.concat_ws("|", "pattern_type", "path", F.col("line_start").cast("string"), "kind"))


def shown_diffs(lines: DataFrame, most: int | None = MOST_DIFF) -> DataFrame:
    """(scan_id, request): the diff as a model is shown it, cut after ``most``
    characters (None: never)."""
    joined = lambda order, part: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, F.col(part).alias("t")))), lambda x: x["t"]), "\n")
    hunks = lines.groupBy("scan_id", "file_idx", "path", "hunk_idx", "new_start").agg(joined("line_idx", "raw").alias("t"), F.count("*").cast("string").alias("n"))
    hunks = hunks.withColumn("t", F.concat(F.lit("@@ -1,"), "n", F.lit(" +"), F.col("new_start").cast("string"), F.lit(","), "n", F.lit(" @@\n"), "t"))
    files = hunks.groupBy("scan_id", "file_idx", "path").agg(joined("hunk_idx", "t").alias("t"))
    files = files.withColumn("t", F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n"), "t"))
    whole = files.groupBy("scan_id").agg(joined("file_idx", "t").alias("request"))
    if most is None:
        return whole
    return whole.withColumn("request", F.when(F.char_length("request") > most, F.concat(F.substring("request", 1, most), F.lit(CUT))).otherwise(F.col("request")))


def assisted(answers: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings (scan_id, idx, pattern_type, path, line_start, line_end,
    confidence, evidence) of answers (scan_id, answer): JSON, of which anything
    else, and one that sees no cheating, gives none."""
    files = lines.groupBy("scan_id").agg(F.max(text.matches(F.col("path"), TEST_FILES).cast("int")).alias("tests"), F.min_by("path", "file_idx").alias("first_path"))
    said = answers.select("scan_id", F.from_json("answer", ANALYSIS).alias("a")).where("a.hasCheating").join(files, "scan_id")
    kept = F.filter("a.findings", lambda f: (F.col("tests") == 1) | ~F.coalesce(f["pattern"].isin(ABOUT_TESTS), F.lit(False)))
    each = said.select("scan_id", "tests", "first_path", F.posexplode(kept).alias("idx", "f"))
    given = lambda c: F.when(F.col(c) != 0, F.col(c))
    path = F.coalesce(F.when(F.col("f.filePath") != "", F.col("f.filePath")), "first_path")
    start = F.coalesce(given("f.lineStart"), F.col("idx") * LINES_APART + 1)
    level = F.when(F.col("f.severity").isin("high", "medium"), F.col("f.severity")).otherwise("low")
    softer = (F.col("f.pattern") == SOFTENED) & (F.col("tests") == 0)
    each = each.select("scan_id", "idx", path.alias("path"), start.cast("int").alias("line_start"), F.coalesce(given("f.lineEnd"), start + LINES_LONG).cast("int").alias("line_end"),
                       F.when(softer, F.when(level == "high", "medium").otherwise("low")).otherwise(level).alias("confidence"), F.col("f.explanation").alias("explanation"))
    lines_ = [F.concat(F.lit("File: "), "path"), F.concat(F.lit("Line: "), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string")), F.concat(F.lit("Issue: "), F.coalesce("explanation", F.lit("")))]
    return each.withColumns({"pattern_type": F.lit("ai_assisted_detection"), "evidence": F.concat_ws("\n", *lines_)}).drop("explanation")


def staged_scores(deduped: DataFrame, verdicts: DataFrame, found: DataFrame, late: DataFrame, scans: DataFrame, files: DataFrame, **options) -> DataFrame:
    """One row per scan: ``static_score``, then ``findings``, ``high_count``,
    ``trust_score``, ``verdict`` after all stages, ``listed`` (findings in all),
    ``judge_filtered`` and ``ai_assisted`` (always 0: what a model found counts
    among ``findings``).

    ``deduped`` are the static findings (``scoring.dedup``), ``verdicts`` the
    same with a column ``verdict``, ``found`` of ``assisted``, ``late``
    (scan_id, n) the number of findings that are listed after the last score.
    """
    columns = ["scan_id", "pattern_type", "path", "line_start", "confidence", "importance", "seq"]
    static = deduped.withColumn("seq", F.col("first_seq")).select(*columns)
    judged = scoring.apply_verdicts(verdicts.withColumn("seq", F.col("first_seq")), F.col("verdict")).select(*columns)
    # what a model finds comes last, and no file's importance weakens it
    appended = found.select("scan_id", "pattern_type", "path", "line_start", "confidence", F.lit(None).cast("string").alias("importance"), (F.lit(1 << 40) + F.col("idx")).alias("seq"))
    now = judged.unionByName(appended)
    touched = verdicts.where("verdict IN ('FALSE_POSITIVE', 'CONTEXTUAL')").select("scan_id").union(found.select("scan_id")).distinct()
    score = lambda f: scoring.scores(f, scans, files, deduplicate=False, **options)
    before = score(static)
    again = score(now.join(touched, "scan_id", "left_semi")).join(touched, "scan_id", "left_semi")
    counted = ["findings", "high_count", "trust_score", "verdict"]
    after = again.select("scan_id", *(F.col(c).alias(f"new_{c}") for c in counted), F.lit(True).alias("touched"))
    n = lambda df, name: df.groupBy("scan_id").agg(F.count("*").alias(name))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    out = before.join(after, "scan_id", "left").join(n(now, "n_now"), "scan_id", "left").join(late.select("scan_id", F.col("n").alias("n_late")), "scan_id", "left")
    out = out.withColumn("listed", zero("n_now") + zero("n_late"))
    pick = lambda c: F.when(F.col("touched"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return out.select("scan_id", F.col("trust_score").alias("static_score"), *map(pick, counted), "listed", F.greatest(F.col("findings") - F.col("listed"), F.lit(0)).alias("judge_filtered"), F.lit(0).alias("ai_assisted"))
