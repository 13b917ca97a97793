"""Rule-based detectors: tables of diff lines in, tables of findings out.

Rules are alternatives of one pattern per language and group, evaluated in one
pass over the lines; conditions on a hunk, file or change set are windows over
the same partitioning, so no detector but D2 and D4 moves rows again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

from ..functions import rules as R
from ..functions import text as T
from ..sources.tables import stored
from . import bodies, susceptibility, syntax

#: What orders findings: detector, file, hunk, pass over the hunk, positions.
ORDER = ("det", "file_idx", "hunk_idx", "phase", "i1", "i2")
COLUMNS = ("scan_id", *ORDER, "pattern_type", "path", "line_start", "line_end", "confidence", "kind", "evidence", "importance")


KEYS = ("scan_id", "file_idx", "hunk_idx")


def _hunk() -> WindowSpec:
    return W.partitionBy(*KEYS)


def _whole_hunk() -> WindowSpec:
    """All of a hunk, in the order that windows over its lines sort by anyway."""
    return _hunk().orderBy("line_idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def _finding(df: DataFrame, pattern: str, phase: int | Column, confidence: Column, kind: Column, evidence: Column, i1="line_idx", i2=None, start="line_no", end="line_no") -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(
        "scan_id", F.lit(R.DETECTORS.index(pattern)).alias("det"), "file_idx", "hunk_idx", (phase if isinstance(phase, Column) else F.lit(phase)).alias("phase"), col(i1).cast("int").alias("i1"),
        (F.lit(0) if i2 is None else col(i2)).cast("int").alias("i2"), F.lit(pattern).alias("pattern_type"), "path", col(start).cast("int").alias("line_start"),
        col(end).cast("int").alias("line_end"), confidence.alias("confidence"), kind.alias("kind"), evidence.alias("evidence"), "importance",
    )


def _functional(lines: DataFrame) -> DataFrame:
    return lines.where("NOT non_functional AND path <> '/dev/null'")


def disabled_assertions(lines: DataFrame) -> DataFrame:
    """D1: skipped, focused, never-true, commented-out and empty tests. Every
    line is judged in one pass; ``phase`` says by which of the three rules."""
    raw, lang = F.col("raw"), F.col("lang")
    rule = lambda table: F.coalesce(T.by_language(lang, table, lambda p: T.matches(raw, p)), F.lit(False))
    skip = (
        F.when(T.matches(raw, r"\.todo\s*\("), "todo")
        .when(~T.matches(raw, r"describe\s*\.\s*skip\s*\(") & T.matches(raw, R.HAS_REASON), "skip_with_reason")
        .otherwise("skip")
    )
    kind = F.when(F.col("marker") == " ", None).when(rule(R.SKIP), skip).when(rule(R.FOCUS), "focus").when(rule(R.NEVER_TRUE), "if_false").when(rule(R.COMMENTED_OUT), "comment")
    # all windows have the order of the lines, so one sort serves them; a source file's first line stands for it
    scan = W.partitionBy("scan_id").orderBy("file_idx", "hunk_idx", "line_idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    source_changed = F.max((~F.col("is_test")).cast("int")).over(scan) == 1
    active = F.max(((F.col("marker") == "+") & ~T.matches(F.col("body"), r"^\s*//") & T.matches(F.col("body"), R.ACTIVE_ASSERTION)).cast("int")).over(_whole_hunk()) == 1
    near = F.max(F.col("kind").isNotNull().cast("int")).over(_hunk().orderBy("line_idx").rangeBetween(-2, 2)) == 1
    free = (F.col("marker") == "+") & ~F.col("near") & raw.contains("(")
    seen = _functional(lines).where("is_test OR (lang IS NOT NULL AND line_idx = 0)").select(*KEYS, "path", "importance", "lang", "is_test", "line_idx", "line_no", "marker", "raw", "body")
    seen = seen.withColumn("source_changed", source_changed).where("is_test").withColumn("kind", kind)
    seen = seen.withColumns({"active": active, "near": near})
    seen = _bare_bodies(seen.withColumns({"inline": free & T.matches(raw, R.EMPTY_TEST), "opens": free & T.matches(raw, R.TEST_OPEN)}))
    # what is left are the few lines of which one rule or another speaks
    few = seen.where("kind IS NOT NULL OR inline OR bare").select(*KEYS, "path", "importance", "line_idx", "line_no", "body", "kind", "source_changed", "active", "inline", "bare")
    few = _apart(few, "inline")
    # those found inline are matches already; an open line near one is passed over
    beside = F.max(F.col("inline").cast("int")).over(_hunk().orderBy("line_idx").rangeBetween(-2, 2)) == 1
    few = _apart(few.withColumn("bare", F.col("bare") & ~beside), "bare")
    phase = F.when(F.col("kind").isNotNull(), 0).when(F.col("inline"), 1).when(F.col("bare"), 2)
    found = few.withColumn("phase", phase).where("phase IS NOT NULL")
    conf = (
        F.when(F.col("phase") > 0, "medium").when(F.col("kind").isin("skip", "focus", "if_false"), "high")
        .when((F.col("kind") == "comment") & ~F.col("source_changed") & ~F.col("active"), "medium")
        .otherwise("low")
    )
    return _finding(found, "disabled_assertion", F.col("phase"), conf, F.coalesce("kind", F.lit("empty_test")), F.substring(T.trim(F.col("body")), 1, 200))


BLOCK = 64  # rows that are folded together


def _apart(rows: DataFrame, flag: str) -> DataFrame:
    """Per hunk, leaves ``flag`` set only where a row is 3 or more lines below
    the last one that keeps it. One fold per hunk over its rows in order, which
    are few; they are cut into blocks so that no list grows row by row."""
    row = F.struct("line_idx", *(c for c in rows.columns if c not in (*KEYS, "line_idx")))
    blocks = rows.withColumn("_block", F.floor(F.col("line_idx") / BLOCK)).groupBy(*KEYS, "_block").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    hunks = blocks.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("_block", "rows"))).alias("blocks"))
    keeps = lambda s, x: x[flag] & (x["line_idx"] - s["last"] >= 3)
    state = lambda last, out: F.struct(last.cast("int").alias("last"), out.alias("out"))
    flags, lists = F.array().cast("array<boolean>"), F.array().cast("array<array<boolean>>")
    inside = lambda a, b: F.aggregate(b["rows"], state(a["last"], flags), lambda s, x: state(F.when(keeps(s, x), x["line_idx"]).otherwise(s["last"]), F.concat(s["out"], F.array(keeps(s, x)))))
    kept = F.aggregate("blocks", state(F.lit(-9), lists), lambda a, b: state(inside(a, b)["last"], F.concat(a["out"], F.array(inside(a, b)["out"]))), lambda a: F.flatten(a["out"]))
    each = hunks.select(*KEYS, F.explode(F.arrays_zip(F.flatten("blocks.rows").alias("r"), kept.alias("keep"))).alias("x"))
    return each.select(*KEYS, "x.r.*", "x.keep").drop(flag).withColumnRenamed("keep", flag)


def _bare_bodies(seen: DataFrame) -> DataFrame:
    """Adds ``bare``: tests that open on such a line (``opens``) and whose
    braces close within 20 lines without an assertion on the way. Only hunks
    with an open line look at the lines that follow."""
    seen = seen.withColumn("opening", F.max(F.col("opens").cast("int")).over(_whole_hunk()) == 1)
    step = F.regexp_count("raw", F.lit(r"\{")) - F.regexp_count("raw", F.lit(r"\}"))
    asserts = ~T.matches(F.col("raw"), r"^\s*//") & T.matches(F.col("raw"), R.BODY_ASSERTION)
    seen = seen.withColumn("step", F.when(F.col("opening"), F.struct(step.alias("by"), asserts.alias("asserts"))))
    after = F.collect_list("step").over(_hunk().orderBy("line_idx").rowsBetween(0, 19))
    # the first that happens inside the braces: 1 they close, 2 an assertion
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("inside"), F.lit(0).alias("end"))
    depth = lambda a, x: a["depth"] + x["by"]
    inside = lambda a, x: a["inside"] | (depth(a, x) > 0)
    event = lambda a, x: F.when(a["end"] > 0, a["end"]).when(~inside(a, x), 0).when(depth(a, x) == 0, 1).when(x["asserts"], 2).otherwise(0)
    end = F.aggregate("after", start, lambda a, x: F.struct(depth(a, x).alias("depth"), inside(a, x).alias("inside"), event(a, x).alias("end")), lambda a: a["end"])
    return seen.withColumn("after", after).withColumn("bare", F.col("opens") & (F.when(F.col("opens"), end) == 1)).drop("after", "step")


def _safe(body: Column) -> Column:
    """Not too long and not nested too deeply for nested patterns."""
    deep = F.rlike(F.regexp_replace(body, r"[^()]", ""), F.lit(r"\({21}"))
    depth = F.aggregate(F.split(F.regexp_replace(body, r"[^()]", ""), ""), F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), lambda a, c: F.struct((a["d"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("d"), F.greatest(a["m"], a["d"] + F.when(c == "(", 1).otherwise(0)).alias("m")))["m"]
    return (F.char_length(body) <= 500) & ~deep & F.when(F.regexp_count(body, F.lit(r"\(")) > 20, depth <= 20).otherwise(True)


def assertions(lines: DataFrame, besides: Column | None = None) -> DataFrame:
    """Assertions on added and removed lines of tests: ``method``, ``value``.
    Lines of other files for which ``besides`` holds come with them."""
    body, lang = F.col("body"), F.col("lang")
    comment = T.by_language(lang, R.COMMENT_START, lambda s: T.matches(body, r"^\s*(" + "|".join(s) + ")"))
    besides = F.lit(False) if besides is None else besides
    changed = _functional(lines).where(besides | (F.expr("is_test AND marker <> ' '") & ~comment & _safe(body)))
    is_js = lang == "javascript"
    known = F.when(is_js, body.contains("expect") & T.matches(body, R.JS_ASSERTION)).otherwise(T.by_language(lang, R.ASSERTION, lambda a: T.matches(body, a[0])))
    value = F.when(is_js, T.trim(F.regexp_extract(body, R.JS_ASSERTION, 2))).otherwise(
        T.by_language(lang, R.ASSERTION, lambda a: F.when(T.matches(body, a[1]), T.trim(F.regexp_extract(body, a[1], 1))).otherwise("<unknown>"))
    )
    found = changed.where(besides | known).withColumn("value", value)
    # in Go the captured value stands for the method as well
    method = F.when(is_js, F.regexp_extract(body, R.JS_ASSERTION, 1)).when(lang == "go", F.when(F.col("value") == "<unknown>", "assert").otherwise(F.col("value"))).otherwise(T.by_language(lang, R.ASSERTION_NAME, F.lit))
    return found.withColumn("method", method)


def _with_sources(lines: DataFrame) -> DataFrame:
    """The assertions with ``sources``: the base names of the source files that
    change in their scan, from the first line of each hunk, in the same pass."""
    base = F.lower(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.\w+$", ""))
    few = ("scan_id", "file_idx", "hunk_idx", "path", "importance", "line_idx", "line_no", "marker", "body", "lang", "is_test")
    source = F.when(~F.col("is_test"), base)
    both = assertions(lines, F.expr("NOT is_test AND lang IS NOT NULL AND line_idx = 0")).select(*few, "value", "method", source.alias("source"))
    return both.withColumn("sources", F.collect_set("source").over(W.partitionBy("scan_id"))).where("is_test").drop("source", "is_test", "lang")


def tampered_assertions(lines: DataFrame) -> DataFrame:
    """D2: removed and added assertions of one method with different values,
    and removed ones that nothing replaces. An equi-join per hunk."""
    keys = ["scan_id", "file_idx", "hunk_idx"]
    side = lambda m, *by: F.count(F.when(F.col("marker") == m, 1)).over(W.partitionBy(*keys, *by))
    marked = stored(_with_sources(lines)).withColumns({
        "in_new": side("+", "method", "value") > 0, "in_old": side("-", "method", "value") > 0, "n_old": side("-"), "n_new": side("+"),
        "method_stays": side("+", "method") > 0, "value_stays": side("+", "value") > 0,
    })
    base = F.lower(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(test|spec|_test|Test)\.?\w*$", ""))
    change = F.when(F.array_contains("sources", base), "specific").when(F.size("sources") > 0, "any").otherwise("none")
    marked = marked.withColumn("change", change)
    old = marked.where("marker = '-'").select(*keys, "method", F.col("value").alias("old_value"), F.col("line_idx").alias("old_idx"), F.col("in_new").alias("old_in_new"))
    plain = lambda c: F.regexp_replace(c, r"""['"`\s]""", "")
    pairs = marked.where("marker = '+'").join(old, [*keys, "method"]).where(plain(F.col("value")) != plain(F.col("old_value")))
    refactored = T.matches(F.col("old_value"), r"""^['"`]""") & T.matches(F.col("old_value"), r"""['"`]$""") & T.matches(F.col("value"), r"^[a-zA-Z_$][a-zA-Z0-9_$.]*$")
    kind = (
        F.when(F.col("change") == "specific", "with_source").when(F.col("change") == "any", "other_source").when(refactored, "refactored")
        .when(F.col("old_in_new") & F.col("in_old"), "swapped").when(F.col("old_in_new") & (F.col("n_new") >= F.col("n_old")), "expanded").otherwise("changed")
    )
    level = lambda k: F.when(k.isin("with_source", "refactored", "expanded"), "low").when(k.isin("other_source", "swapped"), "medium").otherwise("high")
    evidence = F.substring("body", 1, 120)
    changed = _finding(pairs.withColumn("kind", kind), "assertion_tampering", 0, level(F.col("kind")), F.col("kind"), evidence, "old_idx", "line_idx")
    gone = marked.where("marker = '-' AND NOT method_stays AND NOT value_stays AND NOT (n_new >= n_old AND n_new > 0)")
    removed = _finding(gone, "assertion_tampering", 1, F.when(F.col("change") == "none", "medium").otherwise("low"), F.lit("removed"), evidence)
    return changed.unionByName(removed)


def mocks(lines: DataFrame) -> DataFrame:
    """D3: mocks on added lines, and hunks with more mocks than assertions."""
    raw = F.col("raw")

    def first(patterns: list[str]) -> Column:
        return F.coalesce(*(F.when(T.matches(raw, p), F.lit(i)) for i, p in enumerate(patterns)))

    ordered = _hunk().orderBy("line_idx")
    whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # of one sort with ``ordered``
    tests = _functional(lines).where("is_test").withColumn("n_lines", F.count("*").over(whole))
    tests = tests.where("marker = '+'").withColumns({"which": T.by_language(F.col("lang"), R.MOCKS, first), "check": T.matches(raw, R.ANY_ASSERTION)})
    tests = tests.withColumns({"mocks": F.count("which").over(whole), "checks": F.count_if("check").over(whole), "first": F.row_number().over(ordered) == 1})
    conf = F.when(F.col("which").isin(1, 2), "low").when(raw.contains("* as") | ~raw.contains("{"), "high").otherwise("medium")
    text = F.concat(F.lit("Mocks: "), F.col("mocks").cast("string"), F.lit(", Assertions: "), F.col("checks").cast("string"))
    hit = lambda phase, conf, kind, text, i1, start, end: F.struct(F.lit(phase).alias("phase"), conf.alias("conf"), kind.alias("kind"), text.alias("text"), i1.alias("i1"), start.alias("start"), end.alias("end"))
    line_no, kind = F.col("line_no"), F.concat(F.lit("mock_"), F.least("which", F.lit(3)).cast("string"))
    mock = F.when(F.col("which").isNotNull(), hit(0, conf, kind, F.substring(T.trim(F.col("body")), 1, 120), F.col("line_idx"), line_no, line_no))
    excess = F.when(F.expr("first AND checks > 0 AND mocks > checks"), hit(1, F.lit("medium"), F.lit("excessive"), text, F.lit(0), F.col("new_start"), (F.col("new_start") + F.col("n_lines")).cast("int")))
    # both kinds come from one pass over the lines
    found = tests.where("which IS NOT NULL OR first").select(*KEYS, "path", "importance", F.explode(F.array_compact(F.array(mock, excess))).alias("h"))
    return _finding(found, "mock_to_avoid_failure", F.col("h.phase"), F.col("h.conf"), F.col("h.kind"), F.col("h.text"), "h.i1", None, "h.start", "h.end")


def claim_mismatch(lines: DataFrame, scans: DataFrame) -> DataFrame:
    """D4: titles that claim tests over changes that hold none, and cosmetic
    changes of test files."""
    files = lines.groupBy("scan_id", "file_idx", "path", "non_functional", "importance").agg(
        F.count_if(F.col("marker") == "+").alias("added"),
        F.max(((F.col("marker") != " ") & (T.trim(F.col("body")) != "") & ~T.matches(T.trim(F.col("body")), R.COSMETIC)).cast("int")).alias("meaningful"),
    )
    files = files.withColumns({"testish": T.matches(F.col("path"), R.TEST_FILE), "sourceish": T.matches(F.col("path"), R.SOURCE_FILE) & ~T.matches(F.col("path"), R.TEST_FILE) & ~F.col("non_functional")})
    joined = lambda cond: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("file_idx", "path")))), lambda x: x["path"]), ", ")
    hit = lambda phase, conf, kind, path, importance, file_idx: F.struct(F.lit(phase).alias("phase"), conf.alias("conf"), F.lit(kind).alias("kind"), path.alias("path"), importance.alias("importance"), file_idx.alias("file_idx"))
    cosmetic = hit(1, F.lit("low"), "cosmetic", F.col("path"), F.col("importance"), F.col("file_idx"))
    # a scan's files are read once; each kind of finding is a part of its row
    whole = files.groupBy("scan_id").agg(
        F.count_if(~F.col("non_functional")).alias("functional"), F.count_if("testish").alias("tests"), F.count_if("sourceish").alias("sources"),
        joined(F.lit(True)).alias("all_paths"), joined(F.col("sourceish")).alias("source_paths"), F.collect_list(F.when(F.expr("testish AND added >= 5 AND meaningful = 0"), cosmetic)).alias("cosmetic"),
    )
    whole = whole.join(scans.select("scan_id", "pr_title", "pr_author"), "scan_id", "left")
    claims = T.matches(F.coalesce("pr_title", F.lit("")), R.CLAIMS_TESTS)
    honest = F.coalesce(F.col("pr_author").isin(R.BOTS), F.lit(False)) | T.matches(F.col("pr_title"), R.HONEST_TITLE)
    claim = lambda phase, conf, kind, path: hit(phase, conf, kind, path, T.importance(path), F.lit(0))
    docs = F.when(claims & F.expr("functional = 0"), claim(0, F.when(honest, "low").otherwise("medium"), "nothing_functional", F.col("all_paths")))
    code = F.when(claims & F.expr("sources > 0 AND tests = 0"), claim(2, F.lit("medium"), "no_tests", F.col("source_paths")))
    each = whole.select("scan_id", F.explode(F.concat("cosmetic", F.array_compact(F.array(docs, code)))).alias("h")).select("scan_id", "h.*").withColumns({"hunk_idx": F.lit(0), "line_no": F.lit(0)})
    return _finding(each, "claim_diff_mismatch", F.col("phase"), F.col("conf"), F.col("kind"), F.col("path"), F.when(F.col("phase") == 1, F.col("file_idx")).otherwise(0))


def silent_catches(lines: DataFrame) -> DataFrame:
    """D5: handlers that drop the error, on one line or over up to ten. Most
    lines hold none of the words that a handler needs and meet no pattern."""
    body, lang = F.col("body"), F.col("lang")
    base = _functional(lines).where("NOT catch_exempt")
    low = F.lower(body)
    likely = reduce(Column.__or__, (low.contains(w) for w in R.HANDLER_WORDS)) & (F.col("marker") == "+")
    base = base.withColumn("likely", likely)
    rule = lambda table: T.by_language(lang, table, lambda p: T.matches(body, p))
    kind = F.when(F.col("likely"), F.when(rule(R.CATCH_EMPTY), "empty").when(rule(R.CATCH_TODO), "todo").when(rule(R.CATCH_PRINT), "console_only").when(T.matches(body, R.CATCH_NULL), "return_null").when(T.matches(body, R.CATCH_COMMENT), "comment_only").when(T.matches(body, R.FINALLY_EMPTY), "empty_finally"))
    base = base.withColumns({"kind": kind, "t": T.trim(body)})
    opens = F.col("likely") & F.col("kind").isNull() & T.by_language(lang, R.CATCH_OPEN, lambda p: T.matches(F.col("raw"), p)) & ~T.matches(F.col("t"), R.NOT_CATCH) & ~F.coalesce(lang.isin("python", "ruby"), F.lit(False))
    base = base.withColumn("opens", F.coalesce(opens, F.lit(False)))
    base = base.withColumn("opening", F.max(F.col("opens").cast("int")).over(_whole_hunk()) == 1).where("opening OR kind IS NOT NULL")
    # the lines that follow an opener are gathered as small codes
    code = (
        F.when(F.col("marker") == "-", "-").when(F.col("t").startswith("}"), "}").when((F.col("t") == "") | (F.col("t") == "{"), "-")
        .when(T.matches(F.col("t"), R.BODY_COMMENT), F.when(T.matches(F.col("t"), R.UNFINISHED), "t").otherwise("c")).when(T.matches(F.col("t"), R.BODY_PRINT), "p").otherwise("x")
    )
    base = base.withColumn("code", F.when(F.col("opening"), code))
    after = _hunk().orderBy("line_idx").rowsBetween(1, 9)
    base = base.withColumn("next", F.array_join(F.collect_list("code").over(after), "")).withColumn("closing", F.regexp_extract("next", r"^([^}]*)\}", 1))
    block = F.col("opens") & F.col("next").contains("}") & ~F.col("closing").contains("x")
    found = base.withColumn("phase", F.when(F.col("kind").isNotNull(), 0).when(block, 1)).where("phase IS NOT NULL")
    how = F.when(F.col("closing").contains("t"), "block_todo").when(F.col("closing").contains("p"), "block_print").when(F.col("closing").contains("c"), "block_comment").otherwise("block_empty")
    found = found.withColumn("kind", F.coalesce("kind", how))
    conf = F.when(F.col("kind").isin("empty", "return_null", "block_empty"), "high").when((F.col("phase") == 1) | F.col("kind").isin("todo", "comment_only"), "medium").otherwise("low")
    end = F.when(F.col("phase") == 0, F.col("line_no")).otherwise(F.col("line_no") + F.char_length("closing") + 1)
    return _finding(found, "silent_catch_and_pass", F.col("phase"), conf, F.col("kind"), F.substring("t", 1, 200), end=end)


def matcher_lines(lines: DataFrame) -> DataFrame:
    """Adds ``suspect``: what D6 needs of a line that may hold an invented matcher
    or that registers matchers, null on all others, which are most."""
    t, marked = T.trim(F.col("body")), F.col("marker") == "+"
    extends = marked & F.col("body").contains("expect.extend")
    may = F.expr("is_test AND NOT non_functional AND path <> '/dev/null'") & marked & F.rlike("body", F.lit(rf"\.\s*{R.MATCHER_LIKE[1:]}"))
    calls = F.regexp_extract_all(t, F.lit(r"\.\s*([a-zA-Z]+)\s*\("), 1)
    valid = lambda m: F.coalesce(T.by_language(F.col("lang"), R.MATCHERS, lambda names: m.isin(names) if names else F.lit(False)), F.lit(False))
    verdict = lambda m: F.when(m.isin(R.NOT_MATCHERS), None).when(m.isin(R.INVENTED), "invented").when(F.rlike(m, F.lit(R.MATCHER_LIKE)) & ~valid(m) & ~m.isin(R.GLOBALS), "unknown")
    odd = F.filter(F.transform(calls, lambda m: F.struct(m.alias("m"), verdict(m).alias("k"))), lambda x: x["k"].isNotNull())
    odd = F.when(may & (F.size(calls) > 0) & ~F.get(calls, F.lit(0)).isin(R.NOT_MATCHERS), odd)
    suspect = F.struct(*KEYS, "path", "importance", "line_idx", "line_no", t.alias("t"), extends.alias("extends"), odd.alias("odd"))
    few = lines.withColumn("suspect", F.when(may | extends, suspect))
    return few.withColumn("suspect", F.when(F.expr("suspect.extends OR size(suspect.odd) > 0"), F.col("suspect")))


def invented_matchers(lines: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """D6: calls of matchers that no framework has, the first of each line. One
    pass keeps the few lines that may hold one, and those that register matchers;
    only the hunks of these are read again, if there are any. ``seen``: the suspects
    of these lines, where a caller has written them already."""
    if seen is None:
        seen = stored(matcher_lines(lines).where("suspect IS NOT NULL").select("suspect.*"))
    called = seen.where("size(odd) > 0").withColumn("names", F.array().cast("array<string>"))
    register = seen.where("extends").select(*KEYS).distinct()
    if not register.isEmpty():
        own = syntax.registered_matchers(lines.join(register, list(KEYS), "left_semi"))
        called = called.drop("names").join(own, "scan_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    hits = F.filter("odd", lambda x: (x["k"] == "invented") | ~F.array_contains("names", x["m"]))
    found = called.withColumn("hit", F.get(hits, F.lit(0))).where("hit IS NOT NULL")
    return _finding(found, "hallucinated_assertion", 0, F.when(F.col("hit.k") == "invented", "high").otherwise("low"), F.col("hit.m"), F.substring("t", 1, 200))


def invented_imports(lines: DataFrame) -> DataFrame:
    """Added imports from test frameworks of names that none of them has, in any
    file. One of the package variant: not among ``all_findings``."""
    body = T.trim(F.col("body"))
    names = F.transform(F.split(F.regexp_extract(body, r"import\s+\{([^}]*)\}\s*from", 1), ","), lambda n: T.trim(n))
    plain = lambda n: T.trim(F.regexp_replace(n, r"as\s+\w+", ""))
    known = [*R.MATCHERS["javascript"], *R.GLOBALS]
    odd = F.filter(names, lambda n: (n != "") & ~plain(n).isin(known) & ~plain(n).startswith("//"))
    found = lines.where("marker = '+'").where(F.rlike(body, F.lit(R.FRAMEWORK_IMPORT))).withColumn("odd", odd).where(F.size("odd") > 0)
    return _finding(found, "hallucinated_assertion", 1, F.lit("medium"), F.array_join("odd", ", "), F.substring(body, 1, 200))


def agent_instructions(lines: DataFrame) -> DataFrame:
    """D11: suspicious sentences in files that instruct coding agents. Each
    line is matched against all rules in place: no join with the catalogue."""
    text = lines.where("is_agent AND marker = '+' AND path <> '/dev/null'").withColumn("t", T.trim(F.col("body"))).where("t <> ''")
    hit = lambda n, label, severity, pattern: F.when(T.matches(F.col("t"), "(?i)" + pattern), F.struct(F.lit(n).alias("n"), F.lit(label).alias("label"), F.lit(severity).alias("severity")))
    hits = F.filter(F.array(*(hit(n, *r) for n, r in enumerate(R.INSTRUCTIONS))), lambda x: x.isNotNull())
    each = text.select("scan_id", "file_idx", "path", "hunk_idx", "line_idx", F.explode(hits).alias("h"))
    by_label = each.groupBy("scan_id", "file_idx", "path", "h.label", "h.severity").agg(F.count("*").alias("n"), F.min(F.struct("hunk_idx", "line_idx", "h.n")).alias("first"))
    ranked = by_label.withColumn("line_no", F.row_number().over(W.partitionBy("scan_id", "file_idx").orderBy("first")))
    conf = F.when((F.col("severity") == "high") & (F.col("n") >= 2), "high").when((F.col("severity") == "high") | ((F.col("severity") == "medium") & (F.col("n") >= 3)), "medium").otherwise(F.col("severity"))
    return _finding(ranked.withColumns({"hunk_idx": F.lit(0), "importance": F.lit("artifact")}), "agent_instruction_scan", 0, conf, F.col("label"), F.concat_ws(" ", "label", F.col("n").cast("string")), "line_no")


def all_findings(lines: DataFrame, scans: DataFrame, more: list[DataFrame] | None = None) -> DataFrame:
    """The findings of every detector, with ``seq``: their order in a scan.
    ``more``: findings of further detectors, with ``COLUMNS``."""
    parts = [
        disabled_assertions(lines), tampered_assertions(lines), mocks(lines), claim_mismatch(lines, scans), silent_catches(lines), invented_matchers(lines),
        bodies.trivial_bodies(lines), susceptibility.found(lines), agent_instructions(lines), *(more or []),
    ]
    both = reduce(DataFrame.unionByName, (p.select(*COLUMNS) for p in parts))
    return both.withColumn("seq", F.row_number().over(W.partitionBy("scan_id").orderBy(*ORDER)))
