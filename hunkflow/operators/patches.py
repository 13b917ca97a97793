"""Suggested patches for findings: ordered rules per pattern type and language.

The rules are data: a pattern, and what the fixed code is put together from.
``suggest`` makes column expressions of them, ``rule_cases`` the same in SQL.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


class Part(NamedTuple):
    """A piece of fixed code: a group of the rule's pattern (``n``), without
    its first character (``rest``), what ``find`` matches, the code itself, the
    code trimmed, or ``text`` as a comment in the file's language."""

    kind: str
    n: int = 0
    text: str = ""


CODE, TRIMMED = Part("code"), Part("trimmed")


def group(n: int) -> Part:
    return Part("group", n)


def rest(n: int) -> Part:
    return Part("rest", n)


def find(pattern: str) -> Part:
    return Part("find", 0, pattern)


def note(text: str) -> Part:
    return Part("note", 0, text)


class Rule(NamedTuple):
    type: str
    lang: str | None  # None: any
    pattern: str
    put: tuple[Part | str, ...]
    risk: str
    old: Part | None = None  # the first place of this is replaced, not the whole code
    literal: tuple[str, str] | None = None  # every place of one text becomes another


#: Our own templates, tried where no rule below applies: (kind of finding, what
#: to find, what to put, risk); the first that matches wins.
TEMPLATES = [
    ("skip", r"\bdescribe\.skip\s*\(", "describe(", "moderate"),
    ("skip", r"\b(it|test)\.skip\s*\(", "$1(", "safe"),
    ("skip", r"\bx(it|test|describe)\b", "$1", "safe"),
    ("skip_with_reason", r"\b(it|test)\.skip\s*\(", "$1(", "moderate"),
    ("focus", r"\b(it|test|describe)\.only\s*\(", "$1(", "safe"),
    ("focus", r"\bf(it|describe)\b", "$1", "safe"),
    ("if_false", r"if\s*\(\s*(false|0)\s*\)", "if (true)", "risky"),
    ("comment", r"//\s*((?:expect|assert)\s*\()", "$1", "moderate"),
    ("empty", r"catch\s*\((\w+)\)\s*\{[\s/]*\}", "catch ($1) { throw $1 }", "moderate"),
    ("console_only", r"catch\s*\((\w+)\)\s*\{\s*console\.\w+\s*\([^)]*\)\s*;?\s*\}", "catch ($1) { throw $1 }", "moderate"),
    ("return_null", r"catch\s*\((\w+)\)\s*\{\s*return\s+\w+\s*;?\s*\}", "catch ($1) { throw $1 }", "risky"),
    ("toNotExist", r"\.toNotExist\s*\(", ".not.toBeDefined(", "safe"),
    ("mustBe", r"\.mustBe\s*\(", ".toBe(", "safe"),
    ("toNotBe", r"\.toNotBe\s*\(", ".not.toBe(", "safe"),
    ("toHaveValues", r"\.toHaveValues\s*\(", ".toEqual(", "moderate"),
    ("mock_0", r"^\s*(jest|vi)\.(mock|doMock)\s*\(.*$", "", "risky"),
]

# fixed values: the results are these texts
#: Matchers that no framework has, and what they stand for; the first found wins.
MATCHER_MAP = {
    "toExist": "toBeDefined", "toNotExist": "toBeNull", "toNotBe": "not.toBe", "toNotEqual": "not.toEqual", "toNotMatch": "not.toMatch", "toHave": "toHaveProperty",
    "toNotHave": "not.toHaveProperty", "toHas": "toHaveProperty", "toNotHas": "not.toHaveProperty", "toBePresent": "toBeDefined", "toNotBePresent": "toBeNull",
    "toBeValid": "toBeTruthy", "toBeInvalid": "toBeFalsy", "toIncludeAll": "toContain", "toExclude": "not.toContain", "toExcludeAll": "not.toContain",
}


def _rules() -> list[Rule]:
    out: list[Rule] = []
    skip, catch, mock = "disabled_assertion", "silent_catch_and_pass", "mock_to_avoid_failure"

    def swap(lang: str | None, pattern: str, old: Part, put: Part | str, risk: str) -> None:
        out.append(Rule(skip, lang, pattern, (put,), risk, old))

    def noted(lang: str, pattern: str, mark: str, text: str) -> None:
        out.append(Rule(skip, lang, pattern, (mark + " ", TRIMMED, f"  {mark} TODO: {text}"), "moderate"))

    def above(lang: str, pattern: str, text: str, mark: str = "// ") -> None:
        out.append(Rule(skip, lang, pattern, (note("TODO: " + text), "\n", group(1), mark, TRIMMED), "moderate"))

    # fixed values from here on: patterns, the notes they leave, and their risk, in
    # the order in which they are tried
    swap(None, r"(it|test|describe)\.skip\s*\(", find(r"\.skip\s*\("), "(", "safe")
    swap(None, r"(xit|xtest|xdescribe)\s*\(", group(1), rest(1), "safe")
    swap(None, r"(fit|fdescribe)\s*\(", group(1), rest(1), "safe")
    swap(None, r"if\s*\(\s*false\s*\)\s*\{", find(r"if\s*\(\s*false\s*\)\s*\{\s*\n?"), "", "moderate")
    swap(None, r"//\s*(assert|expect|should)", find(r"//\s*"), "", "moderate")
    noted("python", r"^\s*@pytest\.mark\.skip\s*$", "#", "Remove skip or add proper skip condition")
    noted("python", r"^\s*@pytest\.mark\.skipif\s*\(", "#", "Remove conditional skip or justify properly")
    noted("python", r"^\s*@unittest\.(?:skip|skipIf)\s*\(", "#", "Remove skip or justify")
    noted("python", r"self\.skipTest\s*\(", "#", "Remove skipTest call")
    out.append(Rule(skip, "python", r"if\s+False\s*:", (note("TODO: Remove if False: wrapper — code never executes"), "\n", CODE), "moderate"))
    above("go", r"(\s*)t\.(?:Skip|Skipf|SkipNow)\s*\(", "Remove t.Skip() — test should verify behavior")
    noted("java", r"^\s*@(?:Disabled|Ignore)\b", "//", "Remove @Disabled or add proper condition")
    above("java", r"(\s*)(assumeTrue|assumeFalse)\s*\(", "Remove assumption — test may skip silently")
    swap("ruby", r"(xit|xdescribe|xcontext|xspecify)\b", group(1), rest(1), "safe")
    above("ruby", r"(\s*)pending\b", "Remove pending — test should verify behavior", "")
    noted("rust", r"(?i)^\s*#\[ignore\]", "//", "Remove #[ignore] or add conditional compilation")
    above("php", r"(\s*)(?:markTestSkipped|markTestIncomplete)\s*\(", "Remove skip — test should verify behavior")

    js, log, handle = r"(catch\s*(?:\([^)]*\))?\s*\{)", "\n    console.error('[hunkflow] Caught error:', error);\n    ", note("TODO: Add proper error handling")
    out.append(Rule(catch, None, js + r"\s*(\}\s*$)", (group(1), log, handle, "\n  ", group(2)), "moderate"))
    out.append(Rule(catch, None, js + r"\s*//\s*(TODO|FIXME).*(\})", (group(1), log, handle, "\n  ", group(3)), "moderate", group(0)))
    out.append(Rule(catch, None, js + r"\s*console\.\w+\s*\([^)]*\)\s*;?\s*(\})", (group(1), log + "throw error; ", note("Re-throw to fail the test"), "\n  ", group(2)), "risky"))
    out.append(Rule(catch, "python", r"(except\s*\w*\s*:)\s*pass\s*$", (group(1), "\n    ", handle, "\n    print(f'[hunkflow] Caught error: {e}')\n    raise  # Re-raise to ensure test fails"), "risky"))
    out.append(Rule(catch, "go", r"(if\s+err\s*!=\s*nil\s*\{\s*)return\s*(nil|0|\"\")\s*(\})", (group(1), "\n\t\t", handle, '\n\t\tlog.Printf("[hunkflow] Caught error: %v", err)\n\t\treturn fmt.Errorf("wrapping: %w", err)\n\t', group(3)), "risky"))
    out.append(Rule(catch, "java", r"(catch\s*\([^)]*\)\s*\{)\s*(\}\s*$)", (group(1), "\n        ", handle, '\n        System.err.println("[hunkflow] Caught error: " + e.getMessage());\n        throw e;  // Re-throw to fail the test\n    ', group(2)), "risky"))
    out.append(Rule(catch, "ruby", r"(rescue\s+\w*)\s*$", (group(1), "\n  ", handle, '\n  puts "[hunkflow] Caught error: #{e.message}"\n  raise  # Re-raise to fail the test'), "risky"))

    for name, valid in MATCHER_MAP.items():
        out.append(Rule("hallucinated_assertion", None, rf"\.{name}\(", (), "safe", None, (f".{name}(", f".{valid}(")))

    out.append(Rule(mock, None, r"(jest|vi)\.mock\s*\(", (note("TODO: Add real-path test for this module"), "\n// ", CODE), "moderate"))
    for pattern, text in (
        (r"@(?:mock\.)?patch\s*\(", "# TODO: Add real-path test alongside this mock"),
        (r"Mockito\.mock\s*\(|@Mock\b", "// TODO: Add real-path test alongside mock"),
        (r"\.On\s*\(.*\)\.Return\s*\(", "// TODO: Add real-path test alongside mock"),
        (r"allow\(.*\)\.to\s+receive", "# TODO: Add real-path test alongside mock"),
    ):
        out.append(Rule(mock, None, pattern, (text + "\n", CODE), "moderate"))
    return out


RULES = _rules()


def _fixed(rule: Rule, code: Column, lang: Column) -> Column:
    """The fixed code, where the rule applies."""

    def part(p: Part | str) -> Column:
        if isinstance(p, str):
            return F.lit(p)
        if p.kind == "note":  # in the language of the file, or as JavaScript does
            start = F.coalesce(T.by_language(lang, R.COMMENT_START, lambda s: F.lit(s[0])), F.lit("//"))
            return F.concat(start, F.lit(" " + p.text))
        return {
            "code": lambda: code, "trimmed": lambda: T.trim(code), "group": lambda: F.regexp_extract(code, rule.pattern, p.n),
            "rest": lambda: F.substr(F.regexp_extract(code, rule.pattern, p.n), F.lit(2)), "find": lambda: F.regexp_extract(code, f"({p.text})", 1),
        }[p.kind]()

    if rule.literal:
        return F.replace(code, F.lit(rule.literal[0]), F.lit(rule.literal[1]))
    new = F.concat(*map(part, rule.put))
    if rule.old is None:
        return new
    old = part(rule.old)
    at = F.position(old, code)
    return F.concat(F.substr(code, F.lit(1), at - 1), new, F.substr(code, at + F.char_length(old)))


def _apply(pattern_type: Column, kind: Column, code: Column, lang: Column) -> tuple[Column, list[Column], list[str]]:
    """Number of the first rule that applies or null, and each rule's fixed
    code and risk."""
    cases = []
    for r in RULES:
        applies = (pattern_type == r.type) & T.matches(code, r.pattern)
        cases.append((applies if r.lang is None else applies & (lang == r.lang), _fixed(r, code, lang), r.risk))
    cases += [((kind == k) & T.matches(code, p), F.regexp_replace(code, F.lit(p), F.lit(put)), r) for k, p, put, r in TEMPLATES]
    return F.coalesce(*(F.when(cond, F.lit(n)) for n, (cond, _, _) in enumerate(cases))), [c[1] for c in cases], [c[2] for c in cases]


def rule_cases(code: str = "evidence") -> list[tuple[str, str, str]]:
    """SQL of each rule and template: (condition, fixed code, risk), over the
    columns pattern_type, kind, lang and ``code``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    extract = lambda p, n: f"regexp_extract({code}, {quote(p)}, {n})"
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    start = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in R.COMMENT_START.items()) + " ELSE '//' END"

    def part(rule: Rule, p: Part | str) -> str:
        if isinstance(p, str):
            return quote(p)
        return {
            "code": code, "trimmed": f"trim({code}, {space})", "group": extract(rule.pattern, p.n), "rest": f"substr({extract(rule.pattern, p.n)}, 2)",
            "find": extract(f"({p.text})", 1), "note": f"({start} || {quote(' ' + p.text)})",
        }[p.kind]

    out = []
    for r in RULES:
        cond = f"pattern_type = '{r.type}' AND regexp_matches({code}, {quote(r.pattern)})" + (f" AND lang = '{r.lang}'" if r.lang else "")
        new = " || ".join(part(r, p) for p in r.put)
        if r.literal:
            new = f"replace({code}, {quote(r.literal[0])}, {quote(r.literal[1])})"
        elif r.old is not None:
            old = part(r, r.old)
            new = f"substr({code}, 1, instr({code}, {old}) - 1) || {new} || substr({code}, instr({code}, {old}) + length({old}))"
        out.append((cond, new, r.risk))
    for kind, pattern, put, risk in TEMPLATES:
        out.append((f"kind = '{kind}' AND regexp_matches({code}, {quote(pattern)})", f"regexp_replace({code}, {quote(pattern)}, {quote(put.replace('$1', chr(92) + '1'))}, 'g')", risk))
    return out


def suggest(findings: DataFrame) -> DataFrame:
    """One patch per (scan, path, line, pattern): original, fixed, risk, and
    ``seq``, the order of the findings. A finding that no rule fits has none;
    the first finding of a place counts."""
    first = findings.groupBy("scan_id", "path", "line_start", "pattern_type").agg(F.min_by(F.struct("kind", "evidence", "seq"), "seq").alias("f")).select("scan_id", "path", "line_start", "pattern_type", "f.*")
    which, fixed, risks = _apply(F.col("pattern_type"), F.col("kind"), F.col("evidence"), F.col("lang"))
    fixes = first.withColumn("lang", T.language(F.col("path"))).withColumn("which", which).where("which IS NOT NULL")
    code = F.coalesce(*(F.when(F.col("which") == n, c) for n, c in enumerate(fixed)))
    risk = F.element_at(F.array(*map(F.lit, risks)), F.col("which") + 1)
    return fixes.select("scan_id", "path", "line_start", "pattern_type", F.col("evidence").alias("original"), code.alias("fixed"), risk.alias("risk"), "seq")


def apply_to_diff(scans: DataFrame, patches: DataFrame) -> DataFrame:
    """(scan_id, patched) of every change set: each patch, of any risk, replaces
    all places of its original in the diff's text, from the last line to the
    first, and on one line in the order of the findings."""
    ordered = patches.where("original <> ''").groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("line_start")).alias("at"), "seq", "original", "fixed"))).alias("p"))
    joined = scans.join(ordered, "scan_id", "left")
    fixed = F.aggregate("p", F.col("raw_diff"), lambda a, x: F.replace(a, x["original"], x["fixed"]))
    return joined.select("scan_id", F.when(F.col("p").isNull(), F.col("raw_diff")).otherwise(fixed).alias("patched"))
