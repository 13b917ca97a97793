"""How often queries read and move their rows, and what stays the same."""

import re

import pytest
from pyspark.sql import functions as F

from hunkflow.functions.digests import hashed_words
from hunkflow.operators import chunks, documents
from hunkflow.plans import all_queries
from hunkflow.sources import change_sets, diffs, strict

from .conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def reads(df, table="lineitem"):
    return len(re.findall(rf"FileScan parquet [^\n]*/{table}\.parquet", plan(df)))


def query(spark, name):
    return all_queries()[name][0](spark, SMALL)


def test_titles_alone_put_no_text_together(spark):
    titles = change_sets.change_sets(spark, SMALL).select("scan_id", "pr_title")
    assert "Window" not in plan(titles) and "collect_list" not in plan(titles)


def test_lines_are_cut_without_windows(spark):
    scans = spark.createDataFrame([(1, "pre\n@@ -1 +1 @@\n+a\ndiff --git a/x.ts b/x.ts\n@@ -1 +7 @@\n+b\n@@ -1 +9 @@\n-c\ndiff --git bad\n+d")], "scan_id bigint, raw_diff string")
    lines = diffs.parse_lines(scans)
    assert "Window" not in plan(lines)
    rows = lines.orderBy("hunk_idx").select("file_idx", "path", "hunk_idx", "line_no", "raw").collect()
    assert [tuple(r) for r in rows] == [(1, "x.ts", 3, 7, "+b"), (1, "x.ts", 4, 9, "-c"), (2, "unknown", 5, 1, "+d")]


def test_strict_lines_are_cut_in_their_row(spark):
    """Both readings in one pass: no window, no join, nothing moved or written."""
    head = "diff --git a/x.ts b/x.ts\n--- a/x.ts\n+++ b/x.ts"
    good = f"{head}\n@@ -1 +7 @@\n-a\n+b\n@@ -4,2 +9,2 @@\n \n--- c\n+++ d\n" + head.replace("x.ts", "y.py") + "\n@@ -1 +0,0 @@\n-e"
    scans = spark.createDataFrame([(1, good), (2, good.replace("-1 +7", "-1,3 +7"))], "scan_id bigint, raw_diff string")
    lines = strict.parse(scans)
    assert not re.findall("Window|Join|Exchange|FileScan", plan(lines)) and "Window" not in plan(strict.marked_lines(scans))
    rows = lines.orderBy("scan_id", "hunk_idx", "line_idx").select("scan_id", "strict", "file_idx", "path", "hunk_idx", "line_no", "marker", "body").collect()
    assert [tuple(r) for r in rows] == [
        (1, True, 1, "b/x.ts", 1, 7, "-", "a"), (1, True, 1, "b/x.ts", 1, 8, "+", "b"), (1, True, 1, "b/x.ts", 2, 9, " ", ""), (1, True, 1, "b/x.ts", 2, 10, "-", "-- c"), (1, True, 1, "b/x.ts", 2, 11, "+", "++ d"), (1, True, 2, "b/y.py", 3, 1, "-", "e"),
        (2, False, 1, "x.ts", 2, 7, "-", "a"), (2, False, 1, "x.ts", 2, 8, "+", "b"), (2, False, 1, "x.ts", 3, 9, " ", ""), (2, False, 2, "y.py", 5, 0, "-", "e"),
    ]


def test_path_rules_look_once_for_their_start():
    from hunkflow.functions import rules

    paths = "README.md a/readme src/SUPPORT x/LICENSE LICENSE LICENSE.a a.LOCK .github/x b/.github/AGENTS.md AGENTS.md xAGENTS.md b/agents.MD .rules/claude.txt x/.agents/q/r.md .agents/r.py a/Analytics/b analytics/b x/instrument/y a.tsx atsx .aider.conf.yml d/.cursorrules x.yaml .npmrc a.ts".split()
    for table in (rules.NON_FUNCTIONAL, rules.TELEMETRY + [rules.COMPONENT], rules.AGENT_FILES):
        either = [(bool(re.search(rules.any_of(table), p)), bool(re.search(rules.any_by_start(table), p))) for p in paths]
        assert all(a == b for a, b in either) and {a for a, _ in either} == {True, False}
    assert rules.any_by_start(rules.AGENT_FILES).count("(?:^|/)") == 1


@pytest.mark.parametrize("name, most", [("flt_rebrand", 1), ("jn_findings_files", 0), ("sc_async_rescore", 1), ("ag_by_language", 1)])
def test_lines_are_read_once(spark, name, most):
    """What is written on the way is read from there; a scan's id and title take one more look at the items."""
    assert reads(query(spark, name)) <= most


def test_trivial_bodies_sort_once(spark):
    # the lines and, in the gathered hunks, the result's groups: nothing else
    assert len(re.findall(r"\bSort \[scan_id", plan(query(spark, "d7b_trivial_bodies")))) <= 1


def test_trivial_bodies_of_all_change_sets(spark):
    files = query(spark, "src_diff_files").where("NOT non_functional").groupBy("scan_id").count()
    assert query(spark, "d7b_trivial_bodies").join(files.where("count > 5"), "scan_id", "left_semi").count() > 0


def test_chunks_move_no_rows(spark):
    files = spark.createDataFrame([(1, "a.py", "x = 1\n\ndef f():\n    pass\ndef g():"), (2, "b.py", "def h():\n  y"), (3, "c.zz", "def z"), (4, "d.py", None), (5, "e.py", "")], "file_id bigint, path string, content string")
    cut = chunks.by_symbol(files)
    assert "Exchange" not in plan(cut) and "Window" not in plan(cut)
    assert [tuple(r) for r in cut.orderBy("file_id", "chunk").collect()] == [
        (1, "a.py", 0, None, 1, 2, "x = 1\n"), (1, "a.py", 1, "f", 3, 4, "def f():\n    pass"), (1, "a.py", 2, "g", 5, 5, "def g():"),
        (2, "b.py", 1, "h", 1, 2, "def h():\n  y"), (3, "c.zz", 0, None, 1, 1, "def z"), (5, "e.py", 0, None, 1, 1, ""),
    ]


def test_a_word_is_hashed_once(spark):
    text = spark.range(1).select(hashed_words(F.lit("a b"), 16).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert text.index("md5") < text.index("sequence(")  # not inside of the loop over the buckets


def test_words_are_looked_up_where_they_are_read(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i a b c d e f g h"), (2, "x"), (3, None), (1, "a b c d e f g h")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "a b c d e f g h i"), (8, "q")], "item_id bigint, text string")
    found = documents.contamination(docs, bench)
    assert [tuple(r) for r in found.collect()] == [(1, 7, 2)]
    assert "doc_id" not in "".join(re.findall(r"hashpartitioning\([^)]*\)", plan(found).split("Join")[-1]))


def test_a_style_moves_no_words(spark):
    rows = [(1, "b a b! A c"), (2, "x  y\nx"), (3, ""), (4, None), (5, "b a"), (5, "c b a")]
    alone = documents.writing_style(spark.createDataFrame(rows[:4], "doc_id bigint, text string"))
    assert "Exchange" not in plan(alone) and "Window" not in plan(alone)
    style = lambda s: F.substring(F.md5(F.lit(s).cast("binary")), 1, 16)
    want = [tuple(r) for r in spark.range(1).select(F.lit(1), style("b:2|a:2|c:1")).union(spark.range(1).select(F.lit(2), style("x:2|y:1"))).collect()]
    assert sorted(map(tuple, alone.collect())) == want
    both = {r[0]: r[1] for r in documents.writing_style(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert both[5] == spark.range(1).select(style("b:2|a:2|c:1")).first()[0] and both[1] == want[0][1] and set(both) == {1, 2, 5}
