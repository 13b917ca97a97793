"""Unified diffs as tables of lines.

A diff is cut into files, files into hunks and hunks into lines where they are
read, in their change set's row: no window, and no row that holds more than its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rules as R
from ..functions import text as T

HUNK = r"^@@ -(\d+),?(\d*) \+(\d+),?(\d*) @@"
PATH = r"diff --git a/[^ ]+ b/(.+)"
#: An added, removed or context line, which is no name of a file; lines end at \\n alone.
LINE = r"(?md)^(?!\+\+\+ |--- )[-+ ][^\n]*"


def looks_valid(raw: Column) -> Column:
    """Whether a diff is complete enough for a strict parser."""
    last = T.trim(F.element_at(F.split(F.regexp_replace(raw, r"[ \t\n\x0B\f\r]+$", ""), "\n"), -1))
    return F.coalesce(
        (F.char_length(T.trim(raw)) >= 20)
        & raw.contains("diff --git ")
        & F.rlike(raw, F.lit(r"@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"))
        & ~last.startswith("@@")
        & ~last.startswith("diff --git")
        & ~last.contains("[truncated]")
        & (last.startswith("+") | last.startswith("-")),
        F.lit(False),
    )


FILE_COLUMNS = ("path", "lang", "is_test", "non_functional", "catch_exempt", "is_agent", "importance")


def worked_out(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later filters and rules read as it is. A plain column
    is written out anew in each place that mentions it; one row of a list isn't."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def with_file(rows: DataFrame) -> DataFrame:
    """Adds what the column ``path`` says (``FILE_COLUMNS``). The language comes
    first, as a column of its own: the rules that look at it don't repeat it."""
    path, lang = F.col("path"), F.col("lang")
    return worked_out(rows, "lang", T.language(path)).withColumns({
        "is_test": T.is_test(lang, path), "non_functional": T.matches(path, R.any_by_start(R.NON_FUNCTIONAL)),
        "catch_exempt": T.matches(path, R.any_by_start(R.TELEMETRY + [R.COMPONENT])), "is_agent": T.matches(path, R.any_by_start(R.AGENT_FILES)), "importance": T.importance(path),
    })


def parse_lines(scans: DataFrame) -> DataFrame:
    """(scan_id, file_idx, hunk_idx, new_start, line_idx, marker, raw, body,
    line_no) of each added, removed and context line, and what its file's path
    says (``FILE_COLUMNS``): that is worked out once per header and carried on.

    Tolerant: text before the first file header and files without lines leave
    no rows; a null or empty diff has none. ``line_no`` counts removed lines
    too, so it is an offset in the hunk and not a line of the new file.
    """
    pieces = with_pieces(scans.select("scan_id", "raw_diff")).select("scan_id", F.posexplode("pieces").alias("piece", "own"))
    files = pieces.select("scan_id", (F.col("piece") + 1).alias("file_idx"), "own.part", "own.texts")
    files = with_file(worked_out(files.withColumn("head", first_line(F.col("texts"))), "path", named_in("head")))
    files = files.select("scan_id", "file_idx", *FILE_COLUMNS, "part", F.posexplode("texts").alias("at", "text"))
    hunks = files.withColumns({"hunk_idx": (F.col("part") + F.col("at")).cast("int"), "new_start": new_start(F.col("text"), F.col("at"))})
    return lines_of(hunks, F.regexp_extract_all("text", F.lit(LINE), 0))


def with_pieces(rows: DataFrame) -> DataFrame:
    """Puts ``pieces`` in the place of ``raw_diff``: its files, each with its
    ``texts``, the header's and the hunks', and the number (``part``) of the first."""
    # parts are numbered through a change set, from 1 at a file's header
    first = F.rlike("raw_diff", F.lit(rf"^(?:diff --git |{HUNK[1:]})")).cast("int")
    parts = worked_out(rows.withColumn("first", first), "parts", F.split("raw_diff", rf"\n(?=diff --git |{HUNK[1:]})")).drop("raw_diff")
    heads = F.filter(F.transform("parts", lambda t, i: F.when(t.startswith("diff --git "), i)), lambda i: i.isNotNull())
    # each file takes its own parts along, so no text is copied more than once
    own = lambda at, k: F.struct((F.col("first") + at).alias("part"), F.slice("parts", at + 1, F.coalesce(F.get("starts", k + 1), F.size("parts")) - at).alias("texts"))
    return worked_out(parts, "starts", heads).withColumn("pieces", F.transform("starts", own)).drop("first", "parts", "starts")


def first_line(texts: Column) -> Column:
    return F.substring_index(F.get(texts, F.lit(0)), "\n", 1)


def named_in(head: str) -> Column:
    """The path that a file's header names."""
    return F.when(F.rlike(head, F.lit(PATH)), F.regexp_extract(head, PATH, 1)).otherwise("unknown")


def new_start(text: Column, at: Column) -> Column:
    """Where a file's part begins, the header's (0) or a hunk's."""
    return F.when(at == 0, 1).otherwise(F.regexp_extract(text, HUNK, 3).cast("int"))


def lines_of(hunks: DataFrame, lines: Column, *more: str) -> DataFrame:
    """A row per line of each hunk's ``lines``, with the columns of ``parse_lines`` and ``more``."""
    rows = hunks.select("scan_id", "file_idx", *FILE_COLUMNS, "hunk_idx", "new_start", *more, F.posexplode(lines).alias("line_idx", "raw"))
    return rows.select("*", F.substring("raw", 1, 1).alias("marker"), F.expr("substring(raw, 2)").alias("body"), (F.col("new_start") + F.col("line_idx")).alias("line_no")).select(
        "scan_id", "file_idx", *FILE_COLUMNS, "hunk_idx", "new_start", "line_idx", "marker", "raw", "body", "line_no", *more
    )


def parse_viewer(scans: DataFrame) -> DataFrame:
    """Lines as a viewer shows them: kind, and running old and new numbers."""
    raw = F.col("raw")
    lines = scans.select("scan_id", F.posexplode(F.split(F.replace(F.col("raw_diff"), F.lit("\r"), F.lit("")), "\n")).alias("pos", "raw"))
    kind = F.when(F.rlike(raw, F.lit(HUNK)), "header").when(F.rlike(raw, F.lit(r"^(diff |index |--- |\+\+\+ )")), "info").when(raw.startswith("+"), "add").when(raw.startswith("-"), "remove").otherwise("context")
    typed = lines.withColumn("kind", kind)
    by = W.partitionBy("scan_id").orderBy("pos")
    typed = typed.withColumn("hunk", F.sum((F.col("kind") == "header").cast("int")).over(by))
    base = lambda g: F.last(F.when(F.col("kind") == "header", F.regexp_extract(raw, HUNK, g).cast("int")), ignorenulls=True).over(by)
    typed = typed.withColumn("old_base", base(1)).withColumn("new_base", base(3))
    own = W.partitionBy("scan_id", "hunk").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    seen = lambda *kinds: F.coalesce(F.sum(F.col("kind").isin(*kinds).cast("int")).over(own), F.lit(0))
    return typed.where("hunk > 0").select(
        "scan_id", "pos", "kind",
        F.when(F.col("kind").isin("remove", "context"), F.col("old_base") + seen("remove", "context")).cast("int").alias("old_no"),
        F.when(F.col("kind").isin("add", "context"), F.col("new_base") + seen("add", "context")).cast("int").alias("new_no"),
    )


LINES_SQL = rf"""
rw AS (SELECT scan_id, unnest(string_split(raw_diff, chr(10))) AS raw, generate_subscripts(string_split(raw_diff, chr(10)), 1) AS pos FROM change_sets),
mk AS (SELECT *, starts_with(raw, 'diff --git ') AS is_file, regexp_matches(raw, '{HUNK}') AS is_hunk FROM rw),
pt AS (SELECT *, sum(is_file::INT) OVER o AS file_idx, sum((is_file OR is_hunk)::INT) OVER o AS part,
              last_value(CASE WHEN is_file THEN regexp_extract(raw, 'diff --git a/[^ ]+ b/(.+)', 1) END IGNORE NULLS) OVER o AS path,
              last_value(CASE WHEN is_file THEN 1 WHEN is_hunk THEN regexp_extract(raw, '{HUNK}', 3)::INT END IGNORE NULLS) OVER o AS new_start
       FROM mk WINDOW o AS (PARTITION BY scan_id ORDER BY pos)),
ln AS (SELECT *, (row_number() OVER (PARTITION BY scan_id, part ORDER BY pos) - 1)::INT AS line_idx FROM pt
       WHERE file_idx > 0 AND NOT is_file AND NOT is_hunk AND NOT starts_with(raw, '+++ ') AND NOT starts_with(raw, '--- ') AND left(raw, 1) IN ('+', '-', ' ')),
lines AS (SELECT scan_id, file_idx::INT AS file_idx, path, part::INT AS hunk_idx, new_start, line_idx, left(raw, 1) AS marker, raw, substr(raw, 2) AS body, new_start + line_idx AS line_no FROM ln)"""


def _lit(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def rx(col: str, patterns: list[str] | str) -> str:
    """SQL: whether any of the patterns matches."""
    return f"regexp_matches({col}, {_lit(patterns if isinstance(patterns, str) else R.any_of(patterns))})" if patterns else "false"


def by_lang(table: dict, build) -> str:
    default = f" ELSE {build(table[None])}" if None in table else ""
    return "CASE " + " ".join(f"WHEN lang = '{k}' THEN {build(v)}" for k, v in table.items() if k) + default + " END"


FILES_SQL = f"""
fl AS (SELECT DISTINCT scan_id, file_idx, path,
         CASE {' '.join(f"WHEN regexp_matches(lower(path), '({'|'.join(e.replace('.', chr(92) + '.') for e in x)})$') THEN '{k}'" for k, x in R.EXTENSIONS.items())} END AS lang,
         {rx('path', R.NON_FUNCTIONAL)} AS non_functional, {rx('path', R.TELEMETRY + [R.COMPONENT])} AS catch_exempt, {rx('path', R.AGENT_FILES)} AS is_agent,
         CASE WHEN {rx('path', R.TEST_FILE)} THEN 'test' WHEN {rx('path', R.SOURCE_FILE)} THEN 'source' WHEN {rx('path', R.CONFIG_FILE)} THEN 'config' ELSE 'docs' END AS importance FROM lines),
files AS (SELECT *, coalesce({by_lang(R.TEST_PATHS, lambda p: rx('path', p))}, false) AS is_test FROM fl),
x AS (SELECT * FROM lines JOIN files USING (scan_id, file_idx, path))"""
