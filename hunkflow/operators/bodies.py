"""D7b: function bodies cut down to a trivial value, and blocks that never run.

The added lines of a hunk are read from top to bottom: a line that opens a
function hides the lines up to the end of its body, by braces where the
language has them and else by indentation. Whether a line opens a function is
told once per line; what follows is a fold over the few openers of a hunk, on
arrays, and only hunks with an opener are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rules as R
from ..functions import text as T

KEYS = ("scan_id", "file_idx", "hunk_idx")
MOST_FILES = 5  # functional files of the change sets that are looked at, unless asked for otherwise


def _candidates(lines: DataFrame, most_files: int | None) -> DataFrame:
    """Added lines of the hunks that hold an opener, one array per hunk."""
    body, t = F.col("body"), T.trim(F.col("body"))
    hunk = W.partitionBy(*KEYS).orderBy("line_idx")
    whole = hunk.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    added = F.expr("path <> '/dev/null' AND lang <> 'javascript' AND marker = '+' AND raw NOT LIKE '+++%'")
    # a hunk's first line stands for its file; other lines that aren't looked at don't move
    rows = lines.where("NOT non_functional").withColumn("is_added", F.coalesce(added, F.lit(False)))
    rows = rows.where(F.col("is_added") | (F.lit(most_files is not None) & (F.col("line_idx") == 0))).select(*KEYS, "path", "lang", "importance", "line_idx", "is_added", F.when(F.col("is_added"), F.col("body")).alias("body"))
    if most_files is not None:
        scan = W.partitionBy("scan_id").orderBy("file_idx", "hunk_idx", "line_idx")  # of one sort with the hunks'
        before = F.lag("file_idx").over(scan)
        rows = rows.withColumn("first", ~before.eqNullSafe(F.col("file_idx")))
        rows = rows.withColumn("files", F.count_if("first").over(scan.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).where(f"files <= {most_files}")
    added = rows.where("is_added")
    opens = F.coalesce(T.by_language(F.col("lang"), R.BODY_OPENERS, lambda p: T.matches(body, p)), F.lit(False))
    added = added.withColumns({"opens": opens, "never": T.matches(t, R.NEVER_RUN), "t": t})
    added = added.withColumn("any", F.max((F.col("opens") | F.col("never")).cast("int")).over(whole)).where("any = 1")
    net = F.regexp_count("body", F.lit(r"\{")) - F.regexp_count("body", F.lit(r"\}"))
    added = added.withColumns({"i": F.row_number().over(hunk) - 1, "net": net})
    added = added.withColumn("cum", F.sum("net").over(hunk))
    line = F.struct("i", "t", T.indent(body).alias("indent"), "opens", "never", "net", "cum")
    return added.groupBy(*KEYS, "path", "lang", "importance").agg(F.array_sort(F.collect_list(line)).alias("ls"))


def _end(m: Column, by_braces: Column, plus: Column) -> Column:
    """The line after which the block that ``m`` opens is over."""
    ls = F.col("ls")
    brace = F.array_min(F.transform(F.filter(ls, lambda x: (x["i"] > m["i"]) & (x["cum"] - m["cum"] + m["net"] <= 0)), lambda x: x["i"]))
    blank = lambda x: (x["t"] == "") | x["t"].startswith("#")
    indent = F.array_min(F.transform(F.filter(ls, lambda x: (x["i"] > m["i"]) & ~blank(x) & (x["indent"] < m["indent"] + plus)), lambda x: x["i"]))
    return F.coalesce(F.when(by_braces & m["t"].contains("{"), brace), indent, F.size(ls))


def trivial_bodies(lines: DataFrame, most_files: int | None = MOST_FILES) -> DataFrame:
    """Findings: functions of at most two lines of which one is a trivial value
    (phase 0), and conditions that are never true outside of functions (phase 1).
    ``line_start`` counts the hunk's added lines from 1. Change sets with more
    than ``most_files`` functional files are passed over; None looks at all."""
    braces = F.col("lang").isin(R.BRACE_LANGUAGES)
    plus = F.when(braces, 0).otherwise(1)
    hunks = _candidates(lines, most_files).where(F.char_length(T.trim(F.array_join("ls.t", "\n"))) >= 10)
    openers = F.transform(F.filter("ls", lambda x: x["opens"]), lambda m: F.struct(m["i"].alias("i"), _end(m, braces, plus).alias("end")))
    none = F.array().cast("array<struct<i: int, end: int>>")
    hunks = hunks.withColumn("openers", openers.cast("array<struct<i: int, end: int>>"))
    hunks = hunks.withColumn("fns", F.aggregate("openers", none, lambda a, x: F.when((F.size(a) == 0) | (x["i"] >= F.element_at(a, -1)["end"]), F.concat(a, F.array(x))).otherwise(a)))
    trivial = lambda t: F.coalesce(T.by_language(F.col("lang"), R.TRIVIAL_VALUES, lambda p: T.matches(t, p)), F.lit(False))
    short = F.filter("fns", lambda f: (f["end"] > f["i"] + 1) & (f["end"] - f["i"] <= 3) & F.exists(F.slice("ls", f["i"] + 2, f["end"] - f["i"] - 1), lambda x: trivial(x["t"])))
    never = F.filter("ls", lambda x: x["never"] & ~x["opens"] & ~F.exists("fns", lambda f: (f["i"] <= x["i"]) & (x["i"] < f["end"])))
    kind = lambda phase, name: lambda i, end: F.struct(F.lit(phase).alias("phase"), F.lit(name).alias("kind"), i.cast("int").alias("i"), end.cast("int").alias("end"))
    of_body, of_never = kind(0, "trivial_function"), kind(1, "conditional_wrap")
    hits = F.concat(F.transform(short, lambda f: of_body(f["i"], f["end"])), F.transform(never, lambda x: of_never(x["i"], _end(x, F.lit(True), F.lit(0)))))
    each = hunks.select(*KEYS, "path", "importance", F.explode(hits).alias("h")).withColumn("at", (F.col("h.i") + 1).cast("string"))
    evidence = F.when(F.col("h.phase") == 0, F.concat(F.lit("Function at line "), "at", F.lit(" returns trivial value unconditionally."))).otherwise(F.concat(F.lit("if(false) block at line "), "at"))
    return each.select(
        "scan_id", F.lit(R.DETECTORS.index("trivial_body")).alias("det"), "file_idx", "hunk_idx", F.lit(0).alias("phase"), F.col("h.i").alias("i1"), F.lit(0).alias("i2"), F.lit("disabled_assertion").alias("pattern_type"),
        "path", (F.col("h.i") + 1).alias("line_start"), F.col("h.end").alias("line_end"), F.lit("high").alias("confidence"), F.col("h.kind").alias("kind"), evidence.alias("evidence"), "importance",
    )
