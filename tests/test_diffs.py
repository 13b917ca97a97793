"""The parser, the line detectors and the scores on small diffs of our own."""

import pytest

from hunkflow.operators import bodies, detectors, patches, scoring, susceptibility
from hunkflow.sources import change_sets, diffs


def diff(path, *lines, start=1):
    return "\n".join([f"diff --git a/{path} b/{path}", "index 1..2 100644", f"--- a/{path}", f"+++ b/{path}", f"@@ -1,3 +{start},4 @@", *lines])


def scans(spark, *diffs_, title=None, author=None):
    rows = [(i, d, title, author) for i, d in enumerate(diffs_)]
    return spark.createDataFrame(rows, "scan_id long, raw_diff string, pr_title string, pr_author string")


def run(spark, detector, *diffs_):
    return [(r.scan_id, r.line_start, r.confidence, r.kind) for r in detector(diffs.parse_lines(scans(spark, *diffs_))).orderBy("scan_id", "file_idx", "hunk_idx", "phase", "i1").collect()]


def test_parser(spark):
    two = diff("a.ts", "+x", " y", "-z", start=7) + "\n" + diff("b.ts", "+q")
    rows = diffs.parse_lines(scans(spark, two, "", None, "no header\n+x")).orderBy("scan_id", "file_idx", "line_idx").collect()
    assert [(r.path, r.marker, r.body, r.line_no) for r in rows] == [("a.ts", "+", "x", 7), ("a.ts", " ", "y", 8), ("a.ts", "-", "z", 9), ("b.ts", "+", "q", 1)]


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("+it.skip(name, fn)", [("high", "skip")]),
        ("+it.skip('why', fn)", [("low", "skip_with_reason")]),
        ("+describe.skip('x', fn)", [("high", "skip")]),
        ("+test.todo('x')", [("low", "todo")]),
        ("-it.only('x', fn)", [("high", "focus")]),
        (" it.only('x', fn)", []),
        ("+if (false) {", [("high", "if_false")]),
        ("+// expect(x)", [("medium", "comment")]),
        ("+it('a', () => {})", [("medium", "empty_test")]),
    ],
)
def test_disabled(spark, line, expected):
    assert [x[2:] for x in run(spark, detectors.disabled_assertions, diff("src/tests/a.test.ts", line))] == expected
    assert run(spark, detectors.disabled_assertions, diff("src/a.ts", line)) == []


def test_empty_body(spark):
    bare = diff("a.test.ts", "+it('a', () => {", "+  const x = 1", "+})")
    full = diff("a.test.ts", "+it('a', () => {", "+  expect(x).toBe(1)", "+})")
    assert run(spark, detectors.disabled_assertions, bare, full) == [(0, 1, "medium", "empty_test")]


def test_tampering(spark):
    alone = diff("a.test.ts", "-expect(x).toBe(1)", "+expect(x).toBe(2)")
    with_source = alone + "\n" + diff("src/a.ts", "+x")
    removed = diff("a.test.ts", "-expect(x).toBe(1)")
    quoted = diff("a.test.ts", "-expect(x).toBe('1')", '+expect(x).toBe("1")')
    assert run(spark, detectors.tampered_assertions, alone, with_source, removed, quoted) == [(0, 2, "high", "changed"), (1, 2, "low", "with_source"), (2, 1, "medium", "removed")]


def test_mocks(spark):
    lines = ["+vi.mock('./a')", "+vi.mock('./a', () => { return {} })", "+vi.spyOn(a, 'b')", "+vi.fn()"]
    assert [x[2] for x in run(spark, detectors.mocks, diff("a.test.ts", *lines))] == ["high", "medium", "low", "low"]
    excess = run(spark, detectors.mocks, diff("a.test.ts", *lines, "+expect(1)"))
    assert excess[-1] == (0, 1, "medium", "excessive")


@pytest.mark.parametrize(
    ("lines", "expected"),
    [
        (["+catch (e) {}"], [("high", "empty")]),
        (["+catch (e) {", "+  // TODO", "+}"], [("medium", "block_todo")]),
        (["+catch (e) {", "+  throw e", "+}"], []),
        (["+catch (e) { return null }"], [("high", "return_null")]),
        (["+finally {}"], [("low", "empty_finally")]),
        (["+p.catch(() => {})"], []),
    ],
)
def test_silent_catches(spark, lines, expected):
    assert [x[2:] for x in run(spark, detectors.silent_catches, diff("src/a.ts", *lines))] == expected
    assert run(spark, detectors.silent_catches, diff("src/a.tsx", *lines), diff("src/metrics/a.ts", *lines)) == []


def test_matchers(spark):
    lines = ["+expect(x).toNotExist()", "+expect(x).toBe(1)", "+expect(x).toBeShiny()", "+x.toString().mustBe(1)", "+expect(x).toHaveValues([1])"]
    assert run(spark, detectors.invented_matchers, diff("a.test.ts", *lines)) == [(0, 1, "high", "toNotExist"), (0, 3, "low", "toBeShiny"), (0, 5, "high", "toHaveValues")]
    own = ["+expect.extend({ toBeShiny(x) { return x } })", "+expect(x).toBeShiny()"]
    assert run(spark, detectors.invented_matchers, diff("a.test.ts", *own)) == []


def test_instructions(spark):
    text = ["+Skip failing tests.", "+Hide errors.", "+Suppress warnings, hide errors."]
    assert [x[1:] for x in run(spark, detectors.agent_instructions, diff("AGENTS.md", *text))] == [(1, "medium", "skip_tests"), (2, "high", "suppress_errors")]


def test_claims(spark):
    docs, code = diff("docs/a.md", "+x"), diff("src/a.ts", "+x")
    both = scans(spark, docs, code, code + "\n" + diff("a.test.ts", "+x"), title="test: more coverage")
    found = detectors.claim_mismatch(diffs.parse_lines(both), both).orderBy("scan_id").collect()
    assert [(r.scan_id, r.confidence, r.kind) for r in found] == [(0, "medium", "nothing_functional"), (1, "medium", "no_tests")]


def test_scores(spark):
    s = scans(spark, diff("a.test.ts", "+it.only('x', fn)"), diff("a.ts", "+x"), "", diff("a.test.ts", "+xit('a')", "+x", "+x", "+x", "+fit('b')"))
    lines = diffs.parse_lines(s)
    found = detectors.all_findings(lines, s)
    files = lines.selectExpr("scan_id", "file_idx").distinct().groupBy("scan_id").count().withColumnRenamed("count", "files_scanned")
    rows = {r.scan_id: (r.trust_score, r.verdict, r.verdict_confidence) for r in scoring.scores(found, s, files).collect()}
    assert rows == {0: (60, "SUSPICIOUS", "high"), 1: (100, "CLEAN", "high"), 2: (100, None, None), 3: (40, "LIKELY_DECEPTIVE", "medium")}


def test_dedup_keeps_first_of_equals(spark):
    rows = [(1, "p", 3, "a", "low", "test", "x", 1), (1, "p", 3, "b", "high", "test", "y", 2), (1, "p", 3, "c", "high", "test", "z", 3)]
    df = spark.createDataFrame(rows, "scan_id long, path string, line_start int, pattern_type string, confidence string, importance string, kind string, seq int")
    assert [(r.pattern_type, r.first_seq) for r in scoring.dedup(df).collect()] == [("b", 1)]


def test_patches(spark):
    s = scans(spark, diff("a.test.ts", "+it.only('x', fn)", "+expect(x).mustBe(1)"))
    found = detectors.all_findings(diffs.parse_lines(s), s)
    fixes = patches.suggest(found)
    assert sorted((r.line_start, r.fixed, r.risk) for r in fixes.collect()) == [(1, "it('x', fn)", "safe"), (2, "expect(x).toBe(1)", "safe")]
    assert "+it('x', fn)\n+expect(x).toBe(1)" in patches.apply_to_diff(s, fixes).first().patched


@pytest.mark.parametrize(
    ("path", "pattern", "code", "fixed", "risk"),
    [
        ("tests/test_a.py", "disabled_assertion", "@pytest.mark.skip", "# @pytest.mark.skip  # TODO: Remove skip or add proper skip condition", "moderate"),
        ("a_test.go", "disabled_assertion", "t.Skip('slow')", "// TODO: Remove t.Skip() — test should verify behavior\n// t.Skip('slow')", "moderate"),
        ("ATest.java", "disabled_assertion", "@Disabled", "// @Disabled  // TODO: Remove @Disabled or add proper condition", "moderate"),
        ("a_spec.rb", "disabled_assertion", "pending 'x'", "# TODO: Remove pending — test should verify behavior\npending 'x'", "moderate"),
        ("a_spec.rb", "disabled_assertion", "xcontext 'x'", "context 'x'", "safe"),
        ("a.rs", "disabled_assertion", "#[ignore]", "// #[ignore]  // TODO: Remove #[ignore] or add conditional compilation", "moderate"),
        ("ATest.php", "disabled_assertion", "$this->markTestSkipped('x');", "// TODO: Remove skip — test should verify behavior\n// $this->markTestSkipped('x');", "moderate"),
        ("a.test.ts", "disabled_assertion", "exit(); xit('a', f)", "eit(); xit('a', f)", "safe"),  # the first place of the text
        ("a.test.ts", "disabled_assertion", "if (false) { x()", "x()", "moderate"),
        ("a.py", "silent_catch_and_pass", "except ValueError: pass", "except ValueError:\n    # TODO: Add proper error handling\n    print(f'[hunkflow] Caught error: {e}')\n    raise  # Re-raise to ensure test fails", "risky"),
        ("a.ts", "silent_catch_and_pass", "} catch (e) { // TODO later }", "} catch (e) {\n    console.error('[hunkflow] Caught error:', error);\n    // TODO: Add proper error handling\n  }", "moderate"),
        ("a.go", "silent_catch_and_pass", "if err != nil { return nil }", 'if err != nil { \n\t\t// TODO: Add proper error handling\n\t\tlog.Printf("[hunkflow] Caught error: %v", err)\n\t\treturn fmt.Errorf("wrapping: %w", err)\n\t}', "risky"),
        ("a.rb", "silent_catch_and_pass", "rescue Error", 'rescue Error\n  # TODO: Add proper error handling\n  puts "[hunkflow] Caught error: #{e.message}"\n  raise  # Re-raise to fail the test', "risky"),
        ("a.test.ts", "hallucinated_assertion", "expect(x).toNotExist()", "expect(x).toBeNull()", "safe"),
        ("a.test.ts", "hallucinated_assertion", "expect(x).toExcludeAll(y)", "expect(x).not.toContain(y)", "safe"),
        ("ATest.java", "mock_to_avoid_failure", "@Mock Cart cart;", "// TODO: Add real-path test alongside mock\n@Mock Cart cart;", "moderate"),
        ("a.test.ts", "mock_to_avoid_failure", "jest.mock('./db')", "// TODO: Add real-path test for this module\n// jest.mock('./db')", "moderate"),
    ],
)
def test_patches_of_all_languages(spark, path, pattern, code, fixed, risk):
    found = spark.createDataFrame([(1, path, 3, pattern, "any", code, 1)], "scan_id long, path string, line_start int, pattern_type string, kind string, evidence string, seq int")
    assert [(r.fixed, r.risk) for r in patches.suggest(found).collect()] == [(fixed, risk)]


def test_all_patches_are_applied(spark):
    s = scans(spark, diff("a.ts", "+catch (e) { console.log(e) }"), diff("a.ts", "+x"))
    found = detectors.all_findings(diffs.parse_lines(s), s)
    patched = {r.scan_id: r.patched for r in patches.apply_to_diff(s, patches.suggest(found)).collect()}
    assert "throw error;" in patched[0] and patched[1] == diff("a.ts", "+x")


def test_large_hunks(spark):
    lines = ["+it('a', () => {"] + ["+  step()"] * 60 + ["+})"]
    rows = susceptibility.susceptible_hunks(diffs.parse_lines(scans(spark, diff("a.test.ts", *lines), diff("a.test.ts", "+x")))).collect()
    assert [(r.scan_id, r.added, r.assertions) for r in rows] == [(0, 62, 0)]
    assert rows[0].blocks == 61 and rows[0].gaps == 0
    strong = ["+it('a', () => {"] + ["+  await expect(x).rejects.toBe(1)"] * 79
    weak = ["+it('a', () => {", "+  if (x) {", "+  await go", "+  }"] + ["+  step()"] * 86
    both = diffs.parse_lines(scans(spark, diff("a.test.ts", *strong), diff("a.test.ts", *weak)))
    assert {r.scan_id: (r.score, r.confidence, r.gap if "gap" in r else None) for r in susceptibility.susceptible_hunks(both).collect()} == {0: (0, "none", None), 1: (65, "high", None)}
    found = susceptibility.found(both).collect()
    assert [(r.scan_id, r.line_start, r.line_end) for r in found] == [(1, 1, 90)] and "Coverage Gaps: Conditional at line 2:4 has no assertion" in found[0].evidence


@pytest.mark.parametrize(
    ("path", "lines", "expected"),
    [
        ("tests/test_a.py", ["+def test_a(self):", "+    pass"], [(1, 2, "trivial_function")]),
        ("tests/test_a.py", ["+def test_a(self):", "+    x = 1", "+    return x", "+if 0:", "+    pass"], [(4, 5, "conditional_wrap")]),
        ("a.go", ["+func Total() int {", "+\treturn 0", "+}"], [(1, 2, "trivial_function")]),
        ("a.go", ["+func Total() int {", "+\tif false {", "+\t\trun()", "+\t}", "+\treturn n", "+}"], []),
        ("a.java", ["+public boolean ok() {", "+    return true;", "+}"], [(1, 2, "trivial_function")]),
        ("a.java", ["+@Test", "+public boolean ok() {", "+    return true;", "+}"], []),  # the annotation opens a block of three lines
        ("a.rb", ["+def ok", "+  nil", "+end", "+x = 1234567"], [(1, 2, "trivial_function")]),
        ("a.rs", ["+fn ok() {", "+    Ok(())", "+}", "+if false {", "+ run()", "+}"], [(1, 2, "trivial_function"), (4, 5, "conditional_wrap")]),
        ("a.php", ["+public function ok() {", "+  return null;", "+}"], [(1, 2, "trivial_function")]),
        ("a.ts", ["+if (false) {", "+  run()", "+}"], []),
        ("a.py", ["+if 0:"], []),
    ],
)
def test_trivial_bodies(spark, path, lines, expected):
    found = bodies.trivial_bodies(diffs.parse_lines(scans(spark, diff(path, *lines)))).collect()
    assert sorted((r.line_start, r.line_end, r.kind) for r in found) == expected


def test_large_change_sets_skip_trivial_bodies(spark):
    many = "\n".join(diff(f"a{i}.py", "+def f(x):", "+    pass") for i in range(6))
    assert bodies.trivial_bodies(diffs.parse_lines(scans(spark, many))).count() == 0


def test_large_hunks_of_empty_tests(spark):
    import time

    inline = diff("a.test.ts", *(f"+  it('t{i}', () => {{}});" for i in range(20_000)))
    bare = diff("a.test.ts", *(["+  it('t', () => {", "+ foo();", "+ });"] * 7000))
    run(spark, detectors.disabled_assertions, diff("a.test.ts", "+x"))
    began = time.time()
    rows = detectors.disabled_assertions(diffs.parse_lines(scans(spark, inline, bare))).select("scan_id", "line_start", "kind").collect()
    assert time.time() - began < 40
    assert sorted(r.line_start for r in rows if r.scan_id == 0) == list(range(1, 20_001, 3))
    assert sorted(r.line_start for r in rows if r.scan_id == 1) == list(range(1, 21_000, 3))


def test_kept_rows_are_apart(spark):
    import random

    rng = random.Random(4)
    rows = [(s, 1, 1, i, rng.random() < 0.6) for s in range(5) for i in sorted(rng.sample(range(600), 300))]
    df = spark.createDataFrame(rows, "scan_id long, file_idx int, hunk_idx int, line_idx int, bare boolean")
    want = set()
    for s in range(5):
        last = -9
        for _, _, _, i, flag in sorted(r for r in rows if r[0] == s):
            if flag and i - last >= 3:
                want.add((s, i))
                last = i
    got = detectors._apart(df, "bare").collect()
    assert len(got) == len(rows) and {(r.scan_id, r.line_idx) for r in got if r.bare} == want


def test_body_cap_is_a_parameter(spark):
    many = "\n".join(diff(f"m{i}.py", "+def f(a):", "+    # changed for now", "+    return True", "+x = 1") for i in range(7))
    lines = diffs.parse_lines(scans(spark, many))
    assert bodies.trivial_bodies(lines).count() == 0 and bodies.trivial_bodies(lines, None).count() == bodies.trivial_bodies(lines, 7).count() == 7


def test_change_sets_shuffle_items_once(spark):
    """One shuffle of short columns by scan_id, no text; the rest sorts in place."""
    plan = change_sets.change_sets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    of_items = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "REPARTITION_BY_COL" in x]
    assert len(of_items) == 1 and plan.count("Exchange hashpartitioning(") <= 2


def test_parse_sorts_files_not_lines(spark):
    """Lines are cut where they are read: one window, over the files of a scan."""
    rows = spark.createDataFrame([(1, "x\n@@ -1 +5 @@\n+lost\ndiff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n+early\n@@ -1,2 +7,2 @@ def\n+one\r\n-two\n\n\\ none\n three\n@@ odd\n+four\ndiff --git odd\n@@ -0,0 +1 @@\n+last")], "scan_id int, raw_diff string")
    lines = diffs.parse_lines(rows)
    assert lines._jdf.queryExecution().executedPlan().toString().count("Window [") == 1
    got = [tuple(r) for r in lines.orderBy("hunk_idx", "line_idx").select("file_idx", "path", "hunk_idx", "new_start", "line_idx", "raw", "line_no").collect()]
    assert got == [
        (1, "a.py", 2, 1, 0, "+early", 1), (1, "a.py", 3, 7, 0, "+one\r", 7), (1, "a.py", 3, 7, 1, "-two", 8), (1, "a.py", 3, 7, 2, " three", 9), (1, "a.py", 3, 7, 3, "+four", 10), (2, "unknown", 5, 1, 0, "+last", 1),
    ]


def cuts(df):
    """How often a plan cuts diffs into lines."""
    return df._jdf.queryExecution().executedPlan().toString().count("Generate posexplode(regexp_extract_all(")


def test_tampering_reads_lines_once(spark):
    lines = diffs.parse_lines(scans(spark, diff("a.test.ts", "-expect(a).toBe(1)", "+expect(a).toBe(2)") + "\n" + diff("a.ts", "+x")))
    found = detectors.tampered_assertions(lines)
    assert cuts(found) == 0  # they are written, few as they are, and read for each side
    assert [(r.line_start, r.confidence, r.kind) for r in found.collect()] == [(2, "low", "with_source")]


def test_mocks_read_lines_once(spark):
    lines = diffs.parse_lines(scans(spark, diff("a.test.ts", "+jest.fn()", "+vi.mock('./b')", "+expect(a).toBe(1)", start=5)))
    found = detectors.mocks(lines)
    assert cuts(found) == 1
    assert sorted((r.phase, r.i1, r.line_start, r.line_end, r.kind) for r in found.collect())[-1] == (1, 0, 5, 8, "excessive")


def test_claims_read_lines_once(spark):
    rows = scans(spark, diff("docs/a.md", "+x"), diff("a.ts", "+x"), diff("a.test.ts", *["+// x"] * 5), title="test: add tests")
    found = detectors.claim_mismatch(diffs.parse_lines(rows), rows)
    assert cuts(found) == 1
    assert sorted((r.scan_id, r.phase, r.kind) for r in found.collect()) == [(0, 0, "nothing_functional"), (1, 2, "no_tests"), (2, 1, "cosmetic")]


def test_change_sets_gather_in_place(spark):
    """Pieces are gathered over the sort that is there: nothing is aggregated."""
    plan = change_sets.change_sets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan


def test_path_rules_stand_once(spark):
    """A filter on what the language decides reads it; it doesn't work it out again."""
    lines = diffs.parse_lines(scans(spark, diff("a.test.ts", "+x"), diff("B.TEST.TS", "+x"), diff("ts", "+x"), diff("a.b/c", "+x"), diff("x.rb.py", "+x")))
    plan = lines.where("is_test AND NOT non_functional")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
    assert [(r.lang, r.is_test) for r in lines.orderBy("scan_id").collect()] == [("javascript", True), ("javascript", True), (None, False), (None, False), ("python", False)]


def test_invented_matchers_read_lines_once(spark):
    own = diff("a.test.ts", "+expect(x).toBeShiny()", "+expect(x).toNotBe(1)", "+expect(x).toBe(1)", " y.toBeOdder()", "+s.toString().toBeShiny()") + "\n" + diff("setup.md", "+expect.extend({ toBeShiny(a) {}, toNotBe() {} })")
    without = detectors.invented_matchers(diffs.parse_lines(scans(spark, own.replace("expect.extend", "expect.other"))))
    assert cuts(without) == 0
    assert [(r.line_start, r.kind) for r in without.orderBy("line_start").collect()] == [(1, "toBeShiny"), (2, "toNotBe")]
    found = detectors.invented_matchers(diffs.parse_lines(scans(spark, own, diff("b.test.ts", "+expect(x).toBeShiny()"))))
    assert [(r.scan_id, r.line_start, r.kind) for r in found.orderBy("scan_id").collect()] == [(0, 2, "toNotBe"), (1, 1, "toBeShiny")]


def test_invented_names_look_like_matchers():
    import re

    from hunkflow.functions import rules

    assert all(re.search(rules.MATCHER_LIKE, m) for m in rules.INVENTED)


def test_large_hunks_read_lines_once(spark):
    lines = diffs.parse_lines(scans(spark, diff("a.test.ts", *["+  const a = 1"] * 60)))
    found = susceptibility.susceptible_hunks(lines)
    assert cuts(found) == 0 and [(r.added, r.score) for r in found.collect()] == [(60, 25)]
