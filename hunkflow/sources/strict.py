"""Unified diffs whose headers are taken at their word.

A hunk's header says how many lines of the old and the new file follow. Running
counts tell for each line how much is still to come, so a removed line that looks
like a file header is a removed line, and what follows a finished hunk has to be
a header again. A change set that breaks its own promises is read tolerantly
(``diffs.parse_lines``), and so is one that doesn't look complete.

A change set is read in its own row, in arrays of its hunks: no window, and no row
is moved or written. Both readings cut files, so their lines come from one pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import diffs

HEADER = r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
#: What may follow a finished hunk or a pair of file names.
FILE_LINE = r"^(?:Index:\s|diff\s|---\s|\+\+\+\s|={67})"
NAME_LINE = r"^(?:---|\+\+\+)\s"
#: The same in a text of several lines, where no pattern goes beyond a line's end.
_IN_TEXT = lambda p: p.removeprefix("^").replace(r"\s", r"[^\S\n]")
BEGINS = rf"^\n*+{_IN_TEXT(FILE_LINE)}"
LOST = rf"(?md)^{_IN_TEXT(NAME_LINE)}[^\n]*+\n++(?!{_IN_TEXT(FILE_LINE)})[^\n]"


def _count(side: Column) -> Column:
    """The number of lines that a side of a header (``-1,9``) names; 1 if it names none."""
    return F.when(side.contains(","), F.substring_index(side, ",", -1).cast("int")).otherwise(1)


def _with_path(rows: DataFrame) -> DataFrame:
    """Adds ``path``: what the last ``+++`` line of ``head`` names, or else the
    last ``---`` line, up to a tab and without quotes. Step by step, as each text
    is read more than once."""
    line = lambda sign: F.regexp_extract("head", rf"(?sd)^(?:.*\n)?({sign}[^\S\n][^\n]*)", 1)
    rows = diffs.worked_out(rows, "line", line(r"\+\+\+"))
    rows = diffs.worked_out(rows.withColumnRenamed("line", "new_line"), "line", F.when(F.col("new_line") != "", F.col("new_line")).otherwise(line("---")))
    rows = diffs.worked_out(rows, "named", F.regexp_replace(F.split(F.regexp_extract("line", r"^(?:\+\+\+|---)\s+([^\r]*)", 1), "\t")[0], r"\\\\", r"\\"))
    quoted = F.expr("startswith(named, '\"') AND endswith(named, '\"') AND char_length(named) > 1")
    path = F.when(F.col("line") == "", "unknown").when(quoted, F.expr("substring(named, 2, char_length(named) - 2)")).otherwise(F.col("named"))
    return diffs.worked_out(rows, "path", F.when(F.col("head").isNull(), "unknown").otherwise(path)).drop("new_line", "line", "named")


def _consumed(h: Column, lines: Column) -> Column:
    """How many lines of a hunk its header speaks of (``n``), how many of them
    are of the old and the new file, and whether one is of neither (``odd``)."""
    more = lambda a, x: a["open"] & ((a["olds"] < h["old_n"]) | (a["news"] < h["new_n"]) | x.startswith("\\"))
    # an empty line is one of context, but for the text's last
    both = lambda a, x: x.startswith(" ") | ((x == "") & ~(h["final"] & (a["n"] + 2 == F.size(lines))))
    state = lambda n, olds, news, odd, open_: F.struct(n.alias("n"), olds.alias("olds"), news.alias("news"), odd.alias("odd"), open_.alias("open"))

    def step(a: Column, x: Column) -> Column:
        old, new = x.startswith("-") | both(a, x), x.startswith("+") | both(a, x)
        taken = state(a["n"] + 1, a["olds"] + old.cast("int"), a["news"] + new.cast("int"), a["odd"] | ~(old | new | x.startswith("\\")), F.lit(True))
        return F.when(more(a, x), taken).when(a["open"], state(a["n"], a["olds"], a["news"], a["odd"], F.lit(False))).otherwise(a)

    start = state(F.lit(0), F.lit(0), F.lit(0), F.lit(False), h["seg"] > 0)
    return F.aggregate(F.slice(lines, 2, F.size(lines)), start, step)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, inside of a loop over an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _hunk(text: Column, seg: Column, final: Column) -> Column:
    """What the strict reading makes of a hunk's text. What comes before the
    first hunk is a hunk 0 without lines. ``n`` lines after a hunk's header are
    its own; the ``rest`` may name the next file, which then ``begins``."""
    # "@@ -1,2 +3,4 @@", or nothing: one look for all that it names
    sides = F.split(F.regexp_extract(F.substring_index(text, "\n", 1), HEADER, 0), " ")
    numbers = lambda x: (_count(F.get(x, F.lit(1))).alias("old_n"), _count(F.get(x, F.lit(2))).alias("new_n"), F.substring_index(F.substring(F.get(x, F.lit(2)), 2, 99), ",", 1).cast("int").alias("start"))
    promised = lambda x: F.struct(seg.cast("int").alias("seg"), final.alias("final"), (F.size(x) > 1).alias("known"), *numbers(x))

    def told(h: Column, got: Column, rest: Column, begins: Column) -> Column:
        # a header of one line without any is one of none; the end of the text may cut off a side of one line
        short = lambda n, have: (have != n) & ~((have == 0) & (n == 1) & h["final"])
        wrong = ~h["known"] | short(h["old_n"], got["olds"]) | short(h["new_n"], got["news"]) | got["odd"] | (~begins & (F.btrim(rest, F.lit("\n")) != ""))
        # a hunk that leaves nothing starts after the line it names
        start = h["start"] + F.when(h["new_n"] == 0, 1).otherwise(0)
        bad = ((h["seg"] > 0) & wrong) | ((rest != "") & F.rlike(rest, F.lit(LOST)))
        return F.struct(h["seg"].alias("seg"), got["n"].alias("n"), start.alias("start"), rest.alias("rest"), begins.alias("begins"), bad.alias("bad"))

    def after(h: Column, lines: Column, got: Column) -> Column:
        own = F.when(h["seg"] > 0, got["n"] + 1).otherwise(0)
        rest = F.when(own < F.size(lines), F.array_join(F.slice(lines, own + 1, F.size(lines)), "\n")).otherwise("")
        return _bound(rest, lambda rest: _bound((h["seg"] > 0) & (rest != "") & F.rlike(rest, F.lit(BEGINS)), lambda begins: told(h, got, rest, begins)))

    of_lines = lambda h: lambda lines: _bound(_consumed(h, lines), lambda got: after(h, lines, got))
    return _bound(sides, lambda x: _bound(promised(x), lambda h: _bound(F.split(text, "\n"), of_lines(h))))


def _read(scans: DataFrame, only_valid: bool) -> DataFrame:
    """(scan_id, raw_diff, strict, first, texts, files) of each change set: the
    ``texts`` of its hunks, from hunk ``first`` on, and its files, each with what
    is known of its hunks. Those that don't look complete can be left without."""
    rows = scans.select("scan_id", "raw_diff", diffs.looks_valid(F.col("raw_diff")).alias("valid"), F.col("raw_diff").startswith("@@").cast("int").alias("first"))
    rows = diffs.worked_out(rows, "texts", F.when(F.col("valid") | F.lit(not only_valid), F.split("raw_diff", r"\n(?=@@)")))
    rows = diffs.worked_out(rows, "hunks", F.transform("texts", lambda t, i: _hunk(t, i + F.col("first"), i == F.size("texts") - 1)))
    # a file goes from the hunk after which it is named to the next such hunk
    named = F.concat(F.array(F.lit(-1)), F.filter(F.transform("hunks", lambda h, i: F.when(h["begins"], i)), lambda i: i.isNotNull()))
    strict = F.coalesce(F.col("valid") & ~F.exists("hunks", lambda h: h["bad"]), F.lit(False))
    rows = diffs.worked_out(rows.withColumn("strict", strict), "named", F.when(F.col("strict") | F.lit(not only_valid), named))
    head = lambda at: F.when(at >= 0, F.get("hunks", at)["rest"]).when(F.col("first") == 0, F.get("hunks", F.lit(0))["rest"])
    own = lambda at, k: F.slice("hunks", at + 2, F.coalesce(F.get("named", k + 1), F.size("hunks") - 1) - at)
    files = F.transform("named", lambda at, k: F.struct((k + 1).alias("file"), head(at).alias("head"), own(at, k).alias("hunks")))
    return rows.select("scan_id", "raw_diff", "strict", "first", "texts", files.alias("files"))


def _text(h: Column) -> Column:
    return F.get("texts", h["seg"] - F.col("first"))


def marked_lines(scans: DataFrame) -> DataFrame:
    """Every line of every diff (scan_id, pos, raw) with what the strict reading
    makes of it: ``seg`` (hunk), ``idx`` (line of its hunk, from 1), ``consumed``,
    ``op``, whether the whole change set can be read so (``strict``), and of the
    consumed lines ``file``, ``path`` and ``start``."""
    line = lambda f, h: lambda x, i: F.struct(x.alias("raw"), h["seg"].alias("seg"), i.alias("idx"), ((h["seg"] > 0) & (i > 0) & (i <= h["n"])).alias("consumed"), f["file"].alias("file"), f["head"].alias("head"), h["start"].alias("start"))
    lines = F.flatten(F.flatten(F.transform("files", lambda f: F.transform(f["hunks"], lambda h: F.transform(F.split(_text(h), "\n"), line(f, h))))))
    rows = _read(scans, only_valid=False).select("scan_id", "strict", F.size(F.split("raw_diff", "\n")).alias("size"), F.posexplode(lines).alias("pos", "x")).select("scan_id", "pos", "strict", "size", "x.*")
    op = F.when(F.expr("raw = '' AND pos < size - 1"), " ").otherwise(F.substring("raw", 1, 1))
    return _with_path(rows.withColumn("op", op)).select("scan_id", "pos", "raw", "strict", "seg", "idx", "op", "consumed", "file", "path", "start")


def parse(scans: DataFrame) -> DataFrame:
    """As ``diffs.parse_lines``, with the strict reading where a change set
    allows it, and with ``strict``. Strict paths are those of the file headers,
    prefix and all; a line that says that a last line has no end is a line with
    the marker ``\\``. Without any file header the lines after the last hunk
    header are those of a file ``unknown``."""
    rows = _read(scans, only_valid=True)
    hunk = lambda idx, start, lines: F.struct(idx.cast("int").alias("hunk_idx"), start.alias("new_start"), lines.alias("lines"))
    file = lambda head, first, hunks: F.struct(head.alias("head"), first.alias("first"), hunks.alias("hunks"))
    files = F.transform("files", lambda f: file(f["head"], F.lit(None).cast("string"), F.transform(f["hunks"], lambda h: hunk(h["seg"], h["start"], F.slice(F.split(_text(h), "\n"), 2, h["n"])))))
    # the change sets that are left, as they are
    bare = ~F.rlike("raw_diff", F.lit(r"(?m)^diff --git "))
    after = F.regexp_replace("raw_diff", r"(?s)^.*\n(@@ -\d+,?\d* \+\d+,?\d* @@)", "$1")
    headless = F.concat(F.lit("diff --git unknown\n"), F.regexp_replace(after, r"^@@ -\d+,?\d* \+\d+,?\d* @@[^\n]*", ""))
    left = F.when(~F.col("strict") & (T.trim(F.col("raw_diff")) != ""), F.when(bare, headless).otherwise(F.col("raw_diff")))
    rows = rows.select("scan_id", "strict", files.alias("files"), left.alias("raw_diff"))
    rows = diffs.with_pieces(diffs.worked_out(rows.withColumnRenamed("raw_diff", "left"), "raw_diff", F.col("left")).drop("left"))
    loose = F.transform("pieces", lambda p: file(F.lit(None).cast("string"), diffs.first_line(p["texts"]), F.transform(p["texts"], lambda t, i: hunk(p["part"] + i, diffs.new_start(t, i), F.regexp_extract_all(t, F.lit(diffs.LINE), 0)))))
    each = rows.select("scan_id", "strict", F.posexplode(F.coalesce("files", loose)).alias("piece", "own")).select("scan_id", "strict", (F.col("piece") + 1).alias("file_idx"), "own.*")
    each = _with_path(each).withColumnRenamed("path", "named")
    each = diffs.with_file(diffs.worked_out(each, "path", F.when(F.col("strict"), F.col("named")).otherwise(diffs.named_in("first"))))
    each = each.select("scan_id", "strict", "file_idx", *diffs.FILE_COLUMNS, F.explode("hunks").alias("own")).select("scan_id", "strict", "file_idx", *diffs.FILE_COLUMNS, "own.*")
    # an empty line of a hunk is one of context
    return diffs.lines_of(each, F.col("lines"), "strict").withColumn("marker", F.when(F.col("raw") == "", " ").otherwise(F.col("marker")))


_N = lambda g, absent: f"CASE WHEN regexp_extract(raw, '{HEADER}', {g}) = '' THEN {absent} ELSE regexp_extract(raw, '{HEADER}', {g})::INT END"
_NAME_SQL = lambda sign: f"CASE WHEN regexp_matches(said, '^{sign}\\s') THEN regexp_replace(string_split(regexp_extract(said, '^{sign}\\s+([^\r]*)', 1), chr(9))[1], '\\\\\\\\', '\\\\', 'g') END"
#: The same reading in SQL; tables ``change_sets`` and ``valid`` (scan_id, valid) to ``lines``.
LINES_SQL = f"""
a1 AS (SELECT scan_id, valid, unnest(string_split(raw_diff, chr(10))) AS raw, generate_subscripts(string_split(raw_diff, chr(10)), 1) AS pos, len(string_split(raw_diff, chr(10))) AS n FROM change_sets JOIN valid USING (scan_id)),
a2 AS (SELECT *, CASE WHEN raw = '' AND pos < n THEN ' ' ELSE left(raw, 1) END AS op, starts_with(raw, '@@') AS is_at, sum(starts_with(raw, '@@')::INT) OVER (PARTITION BY scan_id ORDER BY pos) AS seg FROM a1),
a3 AS (SELECT *, first_value(CASE WHEN is_at THEN {_N(2, 1)} END) OVER s AS old_n, first_value(CASE WHEN is_at THEN {_N(4, 1)} END) OVER s AS new_n, first_value(CASE WHEN is_at THEN {_N(3, 'NULL')} END) OVER s AS start,
   first_value(is_at AND regexp_matches(raw, '{HEADER}')) OVER s AS known, row_number() OVER s - 1 AS idx,
   coalesce(sum((NOT is_at AND op IN ('-', ' '))::INT) OVER b, 0) AS olds, coalesce(sum((NOT is_at AND op IN ('+', ' '))::INT) OVER b, 0) AS news
   FROM a2 WINDOW s AS (PARTITION BY scan_id, seg ORDER BY pos), b AS (PARTITION BY scan_id, seg ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a4 AS (SELECT *, seg > 0 AND NOT is_at AND max((NOT is_at AND NOT (olds < old_n OR news < new_n OR starts_with(raw, chr(92))))::INT) OVER (PARTITION BY scan_id, seg ORDER BY pos) = 0 AS consumed FROM a3),
a5 AS (SELECT *, CASE WHEN NOT consumed AND NOT is_at AND raw <> '' THEN raw END AS said FROM a4),
a6 AS (SELECT *, regexp_matches(said, '{FILE_LINE}') AS is_file, last_value(said IGNORE NULLS) OVER (PARTITION BY scan_id, seg ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous,
   sum((consumed AND op IN ('-', ' '))::INT) OVER w AS all_old, sum((consumed AND op IN ('+', ' '))::INT) OVER w AS all_new, seg = max(seg) OVER (PARTITION BY scan_id) AS final FROM a5 WINDOW w AS (PARTITION BY scan_id, seg)),
a7 AS (SELECT *, coalesce(seg > 0 AND is_file AND previous IS NULL, false) AS begins, coalesce(NOT is_file AND CASE WHEN previous IS NULL THEN seg > 0 ELSE regexp_matches(previous, '{NAME_LINE}') END, false)
   OR coalesce(seg > 0 AND (NOT known OR (all_old <> old_n AND NOT (all_old = 0 AND old_n = 1 AND final)) OR (all_new <> new_n AND NOT (all_new = 0 AND new_n = 1 AND final)) OR (consumed AND op NOT IN ('+', '-', ' ', chr(92)))), false) AS bad FROM a6),
a8 AS (SELECT *, sum(begins::INT) OVER (PARTITION BY scan_id ORDER BY pos) + 1 AS file, valid AND max(bad::INT) OVER (PARTITION BY scan_id) = 0 AS strict FROM a7),
a9 AS (SELECT *, coalesce(last_value({_NAME_SQL('[+]{3}')} IGNORE NULLS) OVER f, last_value({_NAME_SQL('---')} IGNORE NULLS) OVER f, 'unknown') AS path, (start + CASE WHEN new_n = 0 THEN 1 ELSE 0 END)::INT AS new_start FROM a8 WINDOW f AS (PARTITION BY scan_id, file ORDER BY pos)),
rest AS (SELECT * FROM change_sets ANTI JOIN (SELECT DISTINCT scan_id FROM a9 WHERE strict) k USING (scan_id)),
{diffs.LINES_SQL.strip().replace('FROM change_sets', 'FROM rest').replace('lines AS (', 'tolerant AS (')},
lines AS (SELECT scan_id, file::INT AS file_idx, path, seg::INT AS hunk_idx, new_start, (idx - 1)::INT AS line_idx, op AS marker, raw, substr(raw, 2) AS body, (new_start + idx - 1)::INT AS line_no FROM a9 WHERE strict AND consumed
   UNION ALL SELECT * FROM tolerant)"""
