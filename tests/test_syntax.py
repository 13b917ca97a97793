"""Tokens, brackets and the rules on blocks, on small code of our own."""

from hunkflow.operators import syntax
from hunkflow.sources import diffs
from tests.test_diffs import diff, scans

PAD = ["+const a = 1", "+const b = 2", "+const c = 3", "+const d = 4"]


def found(spark, *lines, path="a.test.ts", **limits):
    rows = syntax.syntax_findings(diffs.parse_lines(scans(spark, diff(path, *PAD, *(f"+{x}" for x in lines)))), **limits)
    return [(r.line_start - 4, r.line_end - 4, r.kind, r.confidence) for r in rows.orderBy("i1", "i2").collect()]


#: Added lines, and what is found: first and last line, kind, confidence.
CASES = [
    (["function ok(a) {", "  return true;", "}"], [(1, 3, "trivial_function", "high")]),
    (["const f = () => { return null }"], [(1, 1, "trivial_function", "high")]),
    (["m(a): boolean { return false }"], [(1, 1, "trivial_function", "high")]),
    (["function ok(a) {", "  b(a)", "  return true", "}"], []),
    (["if (a) { return true }"], []),
    (["function f() { return 'true' }"], []),
    (["const f = async () => {", "  try { await g() } catch (e) { log(e); stop() }", "}"], []),
    (["const f = async () => {", "  try { await g() }", "  catch (e) { throw e }", "}"], [(1, 4, "async_gutted", "high")]),
    (["try { a() } catch {}"], [(1, 1, "async_gutted", "high")]),
    (["try {", "  a()", "} catch (e) {", "  // } nothing", "}"], [(1, 5, "async_gutted", "high")]),
    (["try { a() } catch (e) { return 1 }"], []),
    (["p.catch(() => { return e + 1 })"], []),
    (["it('x', () => {})"], [(1, 1, "empty_test_shell", "medium")]),
    (["it('x', () => { todo })"], [(1, 1, "empty_test_shell", "medium")]),
    (["it('{', () => { /* } */ a('}') })"], []),
    (["if (false) { a() }"], [(1, 1, "conditional_wrap", "high")]),
    (["if (0) a()"], [(1, 1, "conditional_wrap", "high")]),
    (["if (cfg.skipAll) { a() }", "if (!mocked) b()"], [(1, 1, "conditional_wrap", "medium"), (2, 2, "conditional_wrap", "medium")]),
    (["if (a && skip) { b() }"], []),
    (["switch (a) {", "  case 1: b(); c(); break", "  default: d()", "}"], [(1, 4, "conditional_wrap", "medium")]),
    (["switch (a) {", "  default:", "    b()", "    c()", "  case 1: d()", "}"], []),
    (["function f( { return true }"], []),
    (["`${a} {`; it('x', () => {", "})"], [(1, 2, "empty_test_shell", "medium")]),
]


def test_rules(spark):
    texts = [diff("a.test.ts", *PAD, *(f"+{x}" for x in code)) for code, _ in CASES]
    rows = syntax.syntax_findings(diffs.parse_lines(scans(spark, *texts))).orderBy("scan_id", "i1", "i2").collect()
    for i, (code, want) in enumerate(CASES):
        assert [(r.line_start - 4, r.line_end - 4, r.kind, r.confidence) for r in rows if r.scan_id == i] == want, code


def test_limits(spark):
    one = ["function ok(a) {", "  return true;", "}"]
    assert found(spark, *one, path="src/a.ts") == [] and len(found(spark, *one, path="x/tests/a.js")) == 1
    short = diff("a.test.ts", "+f(() => {})", "+a", "+b", "+c")
    assert syntax.syntax_findings(diffs.parse_lines(scans(spark, short))).count() == 0
    far = ["x" * 5000, *one]
    assert found(spark, *far) == [] and len(found(spark, *far, most_chars=None)) == 1
    many = "\n".join(diff(f"t{i}.test.ts", *PAD, *(f"+{x}" for x in one)) for i in range(7))
    lines = diffs.parse_lines(scans(spark, many, None, ""))
    assert syntax.syntax_findings(lines).count() == 0
    assert syntax.syntax_findings(lines, most_files=None).count() == 5 and syntax.syntax_findings(lines, most_files=None, most_hunks=None).count() == 7


def test_large_hunk(spark):
    code = ["it('x', () => {", "  if (a) { b({ c: [1] }) }", "  return true", "})"] * 5000 + ["const f = () => { return null }"]
    assert found(spark, *code, most_chars=None) == [(20_001, 20_001, "trivial_function", "high")]


def test_brackets_pair_up(spark):
    import random

    rng = random.Random(6)
    texts = ["".join(rng.choices("(){}[];", k=40)) for _ in range(60)]
    toks = syntax.tokens(spark.createDataFrame(list(enumerate(texts)), "k int, code string"), "k")
    rows = syntax.blocks(toks, "k").select("k", "pos", "close_pos").collect()
    for k, text in enumerate(texts):
        got = {(r.pos, r.close_pos) for r in rows if r.k == k}
        stack, want, pairs = [], set(), {"(": ")", "[": "]", "{": "}"}
        for i, c in enumerate(text):
            if c in pairs:
                stack.append(i)
            elif c in ")]}" and stack:
                at = stack.pop()
                if pairs[text[at]] == c:
                    want.add((at, i))
            elif c in ")]}":
                break  # what closes more than was open leaves the rest to be read at a lower level
        else:
            assert got == want, text


def test_registered_matchers(spark):
    lines = ["+expect.extend({ toBeShiny(x) { if (x) { return { pass: toNest() } } }, // toComment", "+  // a note with expect.extend({ toNote })", "+  'toString': 1, toPlain })", "+toOutside()", "-toRemoved", " expect(x).toBeShiny()"]
    rows = syntax.registered_matchers(diffs.parse_lines(scans(spark, diff("a.test.ts", *lines), diff("b.test.ts", "+expect(toNothing)"), diff("c.test.ts", "-expect.extend({ toGone })"))))
    assert {(r.scan_id, n) for r in rows.collect() for n in r.names if n.startswith("to")} == {(0, "toBeShiny"), (0, "toNest"), (0, "toPlain")}


def test_syntax_reads_lines_once(spark):
    lines = diffs.parse_lines(scans(spark, diff("a.test.ts", "+function f() {", "+  return true", "+}")))
    got = syntax.syntax_findings(lines, most_files=None, most_hunks=None, most_pieces=None, most_chars=None, least_added=1)
    assert got._jdf.queryExecution().executedPlan().toString().count("Generate posexplode(regexp_extract_all(") == 0
    assert [r.kind for r in got.collect()] == ["trivial_function"]
