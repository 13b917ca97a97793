"""Queries over derived change sets: parse, detect, score; and their SQL."""

from __future__ import annotations

import contextlib
import re

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import detectors as D
from ..operators import evaluate, scoring, stages
from ..operators.bodies import trivial_bodies
from ..operators import syntax as S
from ..operators.susceptibility import susceptible_hunks
from ..sources import change_sets, diffs, strict
from ..sources.tables import shared_path, stored


def _scans(spark, sf_dir):
    return change_sets.change_sets(spark, sf_dir)


def _lines(spark, sf_dir):
    return diffs.parse_lines(_scans(spark, sf_dir))


def _detector(f):
    def query(spark, sf_dir):
        return f(_lines(spark, sf_dir)).select("scan_id", "file_idx", "hunk_idx", "phase", "i1", "i2", "path", "line_start", "line_end", "confidence", "kind", "evidence", "importance")

    return query


def diff_lines(spark, sf_dir):
    return _lines(spark, sf_dir)


def diff_files(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("scan_id", "file_idx", *diffs.FILE_COLUMNS).agg(F.count_if(F.col("marker") == "+").alias("added"), F.count_if(F.col("marker") == "-").alias("removed"))


def looks_valid(spark, sf_dir):
    return _scans(spark, sf_dir).select("scan_id", diffs.looks_valid(F.col("raw_diff")).alias("valid"), F.regexp_count("raw_diff", F.lit("(?m)^diff --git")).alias("n_files"))


def viewer_lines(spark, sf_dir):
    return diffs.parse_viewer(_scans(spark, sf_dir))


def d4_claims(spark, sf_dir):
    scans = _scans(spark, sf_dir)
    return _detector(lambda lines: D.claim_mismatch(lines, scans))(spark, sf_dir)


def d10_susceptible_hunks(spark, sf_dir):
    return susceptible_hunks(_lines(spark, sf_dir))


@contextlib.contextmanager
def kept(lines):
    """The lines, kept for as long as several detectors read them. A line's text
    without its marker, and its number, are not kept but worked out again."""
    short = lines.drop("body", "line_no").persist()
    try:
        yield short.withColumns({"body": F.expr("substring(raw, 2)"), "line_no": F.col("new_start") + F.col("line_idx")}).select(*lines.columns)
    finally:
        short.unpersist()


def found_of(lines, scans):
    """All findings, written."""
    with kept(lines) as lines:
        return stored(D.all_findings(lines, scans))


def _findings(spark, sf_dir):
    scans = _scans(spark, sf_dir)
    lines = diffs.parse_lines(scans)
    return found_of(lines, scans), scans, lines


def findings(spark, sf_dir):
    return _findings(spark, sf_dir)[0].select("scan_id", "seq", "pattern_type", "path", "line_start", "line_end", "confidence", "kind", "importance")


def deduped_findings(spark, sf_dir):
    return scoring.fused(scoring.dedup(_findings(spark, sf_dir)[0])).select("scan_id", "path", "line_start", "pattern_type", "confidence", "first_seq", "rank", "base", "penalty")


def scores_of(lines, scans, more=lambda lines: []):
    """Scores of parsed change sets; ``more`` adds findings of further detectors."""
    with kept(lines) as lines:
        files = stored(lines.groupBy("scan_id").agg(F.count_distinct("file_idx").alias("files_scanned")))
        found = stored(D.all_findings(lines, scans, more(lines)))
    return scoring.scores(found, scans, files)


def trust_scores(spark, sf_dir):
    scans = _scans(spark, sf_dir)
    return scores_of(diffs.parse_lines(scans), scans)


def d7a_syntax_findings(spark, sf_dir):
    """The syntax rules on all added code, whatever the size of a change set."""
    return _detector(lambda lines: S.syntax_findings(lines, most_files=None, most_hunks=None, most_pieces=None, most_chars=None, least_added=1))(spark, sf_dir)


def d7b_trivial_bodies(spark, sf_dir):
    """Trivial bodies in all change sets, whatever the number of their files."""
    return _detector(lambda lines: trivial_bodies(lines, most_files=None))(spark, sf_dir)


def syntax_trust_scores(spark, sf_dir):
    """Trust scores to which the syntax rules contribute, within their limits."""
    scans = _scans(spark, sf_dir)
    return scores_of(diffs.parse_lines(scans), scans, lambda lines: [S.syntax_findings(lines)])


def src_strict_lines(spark, sf_dir):
    return strict.parse(change_sets.change_sets(spark, sf_dir, exact=True))


def strict_trust_scores(spark, sf_dir):
    """Trust scores of change sets most of which a strict parser accepts."""
    scans = change_sets.change_sets(spark, sf_dir, exact=True)
    return scores_of(strict.parse(scans).drop("strict"), scans)


#: Stands in for a model: the first digit of the hash of what it is asked decides.
_DIGIT = "substr(hash, 1, 1)"
VERDICT = f"CASE WHEN {_DIGIT} <= '3' THEN 'FALSE_POSITIVE' WHEN {_DIGIT} <= '7' THEN 'CONTEXTUAL' WHEN {_DIGIT} <= 'd' THEN 'VALID' END"
ANALYSIS = f"""CASE WHEN {_DIGIT} <= '5' THEN concat('{{"hasCheating": true, "findings": [{{"pattern": "test_silencing", "severity": "high", "explanation": "quiet"}}, {{"pattern": "semantic_bypass", "severity": "', CASE WHEN {_DIGIT} <= '2' THEN 'high' ELSE 'odd' END,
  '", "explanation": "around", "filePath": "src/cart.ts", "lineStart": 7}}]}}') WHEN {_DIGIT} <= '8' THEN '{{"hasCheating": false, "findings": [{{"pattern": "other"}}]}}' WHEN {_DIGIT} <= 'a' THEN 'no JSON' END"""


def sc_staged_scores(spark, sf_dir):
    """Scores after a judge's verdicts, a model's findings and late rules."""
    scans = _scans(spark, sf_dir)
    with kept(diffs.parse_lines(scans)) as lines:
        files = stored(lines.groupBy("scan_id").agg(F.count_distinct("file_idx").alias("files_scanned")))
        deduped = stored(scoring.dedup(D.all_findings(lines, scans)))
        late = stored(trivial_bodies(lines).groupBy("scan_id").agg(F.count("*").alias("n")))
        shown = stages.answered(stages.shown_diffs(lines), shared_path(spark), lambda asked: asked.withColumn("answer", F.expr(ANALYSIS)))
        found = stored(stages.assisted(shown, lines))
    verdicts = stages.answered(stages.judge_requests(deduped), shared_path(spark), lambda asked: asked.withColumn("answer", F.expr(VERDICT)))
    return stages.staged_scores(deduped, verdicts.withColumnRenamed("answer", "verdict"), found, late, scans, files)


def ev_score_labels(spark, sf_dir):
    """Labels that the scores of unseen change sets allow, and their bands of 20."""
    scored = trust_scores(spark, sf_dir)
    bucket = F.least(F.floor(F.greatest(F.col("trust_score") - 1, F.lit(0)) / 20) * 20 + 20, F.lit(100)).cast("int")
    return scored.select("scan_id", evaluate.auto_label(F.col("findings"), F.col("trust_score")).alias("l"), bucket.alias("up_to")).select("scan_id", "l.*", "up_to")


QUERIES = {
    "ev_score_labels": ev_score_labels,
    "sc_staged_scores": sc_staged_scores,
    "src_strict_lines": src_strict_lines,
    "strict_trust_scores": strict_trust_scores,
    "d7a_syntax_findings": d7a_syntax_findings,
    "syntax_trust_scores": syntax_trust_scores,
    "src_diff_lines": diff_lines,
    "src_diff_files": diff_files,
    "src_looks_valid": looks_valid,
    "src_viewer_lines": viewer_lines,
    "d1_disabled_assertions": _detector(D.disabled_assertions),
    "d2_tampered_assertions": _detector(D.tampered_assertions),
    "d3_mocks": _detector(D.mocks),
    "d4_claim_mismatch": d4_claims,
    "d5_silent_catches": _detector(D.silent_catches),
    "d6_invented_matchers": _detector(D.invented_matchers),
    "d7b_trivial_bodies": d7b_trivial_bodies,
    "d10_susceptible_hunks": d10_susceptible_hunks,
    "d11_agent_instructions": _detector(D.agent_instructions),
    "findings": findings,
    "deduped_findings": deduped_findings,
    "trust_scores": trust_scores,
}

rx, by = diffs.rx, diffs.by_lang
_BASE = f"{change_sets.SQL}, {diffs.LINES_SQL}, {diffs.FILES_SQL}"
_TRIM = lambda c: f"regexp_replace({c}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"
_FUNC = "SELECT * FROM x WHERE NOT non_functional AND path <> '/dev/null'"
_RULE = lambda table, col="raw": f"coalesce({by(table, lambda p: rx(col, p))}, false)"
_OUT = "scan_id, file_idx, hunk_idx, {phase} AS phase, {i1} AS i1, {i2} AS i2, path, {start} AS line_start, {end} AS line_end, {conf} AS confidence, {kind} AS kind, {ev} AS evidence, importance"


def _out(phase=0, i1="line_idx", i2="0", start="line_no", end="line_no", conf="conf", kind="kind", ev="ev"):
    return _OUT.format(**locals())


_GREEDY = "list_reduce(list_prepend([-9], list_transform(list_sort(list(line_idx) OVER h), lambda i: [i])), lambda a, b: CASE WHEN b[1] - a[-1] >= 3 THEN list_concat(a, b) ELSE a END)"
_HUNK = "(PARTITION BY scan_id, file_idx, hunk_idx)"
D1_SQL = f"""
t1 AS (SELECT *, max((NOT is_test AND lang IS NOT NULL)::INT) OVER (PARTITION BY scan_id) = 1 AS source_changed FROM ({_FUNC})),
t2 AS (SELECT *, {_TRIM('body')}[1:200] AS ev, CASE WHEN marker = ' ' THEN NULL WHEN {_RULE(R.SKIP)} AND {rx('raw', r'.todo[ ]*[(]'.replace('.todo[ ]*[(]', chr(92) + '.todo' + chr(92) + 's*' + chr(92) + '('))} THEN 'todo'
   WHEN {_RULE(R.SKIP)} THEN CASE WHEN NOT {rx('raw', chr(92).join(['describe', 's*', '.', 's*skip', 's*', '(']))} AND {rx('raw', R.HAS_REASON)} THEN 'skip_with_reason' ELSE 'skip' END
   WHEN {_RULE(R.FOCUS)} THEN 'focus' WHEN {_RULE(R.NEVER_TRUE)} THEN 'if_false' WHEN {_RULE(R.COMMENTED_OUT)} THEN 'comment' END AS kind FROM t1 WHERE is_test),
t3 AS (SELECT *, max((marker = '+' AND NOT regexp_matches(body, '^\\s*//') AND {rx('body', R.ACTIVE_ASSERTION)})::INT) OVER {_HUNK} = 1 AS active,
   max((kind IS NOT NULL)::INT) OVER (PARTITION BY scan_id, file_idx, hunk_idx ORDER BY line_idx RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS near FROM t2),
e1 AS (SELECT * FROM (SELECT *, {_GREEDY} AS keep FROM t3 WHERE marker = '+' AND NOT near AND {rx('raw', R.EMPTY_TEST)} WINDOW h AS {_HUNK}) WHERE list_contains(keep, line_idx)),
op AS (SELECT * FROM t3 WHERE marker = '+' AND NOT near AND {rx('raw', R.TEST_OPEN)}),
pr AS (SELECT o.scan_id, o.file_idx, o.hunk_idx, o.line_idx, a.line_idx AS j, sum(length(a.raw) - length(replace(a.raw, '{{', '')) - length(a.raw) + length(replace(a.raw, '}}', ''))) OVER w AS depth,
   NOT regexp_matches(a.raw, '^\\s*//') AND {rx('a.raw', R.BODY_ASSERTION)} AS asserts
   FROM op o JOIN t3 a ON a.scan_id = o.scan_id AND a.file_idx = o.file_idx AND a.hunk_idx = o.hunk_idx AND a.line_idx BETWEEN o.line_idx AND o.line_idx + 19
   WINDOW w AS (PARTITION BY o.scan_id, o.file_idx, o.hunk_idx, o.line_idx ORDER BY a.line_idx)),
ps AS (SELECT *, max((depth > 0)::INT) OVER (PARTITION BY scan_id, file_idx, hunk_idx, line_idx ORDER BY j) = 1 AS inside FROM pr),
en AS (SELECT scan_id, file_idx, hunk_idx, line_idx FROM ps GROUP BY ALL HAVING min(CASE WHEN inside AND depth = 0 THEN j END) IS NOT NULL
   AND coalesce(min(CASE WHEN inside AND depth <> 0 AND asserts THEN j END), 1000000) > min(CASE WHEN inside AND depth = 0 THEN j END)),
e2 AS (SELECT * FROM op SEMI JOIN en USING (scan_id, file_idx, hunk_idx, line_idx) ANTI JOIN e1 ON e1.scan_id = op.scan_id AND e1.file_idx = op.file_idx AND e1.hunk_idx = op.hunk_idx AND abs(e1.line_idx - op.line_idx) < 3),
e3 AS (SELECT * FROM (SELECT *, {_GREEDY} AS keep FROM e2 WINDOW h AS {_HUNK}) WHERE list_contains(keep, line_idx)),
d1 AS (SELECT {_out(conf="CASE WHEN kind IN ('skip', 'focus', 'if_false') THEN 'high' WHEN kind = 'comment' AND NOT source_changed AND NOT active THEN 'medium' ELSE 'low' END")} FROM t3 WHERE kind IS NOT NULL
   UNION ALL SELECT {_out(1, conf="'medium'", kind="'empty_test'")} FROM e1 UNION ALL SELECT {_out(2, conf="'medium'", kind="'empty_test'")} FROM e3)"""

_JS, _A = R.JS_ASSERTION, R.ASSERTION
_X = lambda p, g: f"regexp_extract(body, {diffs._lit(p)}, {g})"
D2_SQL = f"""
as1 AS (SELECT * FROM ({_FUNC}) WHERE is_test AND marker <> ' ' AND length(body) <= 500 AND NOT {by(R.COMMENT_START, lambda s: rx('body', chr(94) + chr(92) + 's*(' + '|'.join(s) + ')'))}
   AND CASE WHEN lang = 'javascript' THEN {rx('body', _JS)} ELSE {by(_A, lambda a: rx('body', a[0]))} END),
as2 AS (SELECT *, body[1:120] AS ev, CASE WHEN lang = 'javascript' THEN {_TRIM(_X(_JS, 2))} ELSE {by(_A, lambda a: f"CASE WHEN {rx('body', a[1])} THEN {_TRIM(_X(a[1], 1))} ELSE '<unknown>' END")} END AS value FROM as1),
as3 AS (SELECT *, CASE WHEN lang = 'javascript' THEN {_X(_JS, 1)} WHEN lang = 'go' THEN CASE WHEN value = '<unknown>' THEN 'assert' ELSE value END ELSE {by(R.ASSERTION_NAME, diffs._lit)} END AS method FROM as2),
sc AS (SELECT scan_id, list(DISTINCT lower(regexp_replace(string_split(path, '/')[-1], '\\.\\w+$', ''))) AS sources FROM ({_FUNC}) WHERE NOT is_test AND lang IS NOT NULL GROUP BY scan_id),
as4 AS (SELECT *, CASE WHEN list_contains(sources, lower(regexp_replace(string_split(path, '/')[-1], '\\.(test|spec|_test|Test)\\.?\\w*$', ''))) THEN 'specific' WHEN sources IS NOT NULL THEN 'any' ELSE 'none' END AS change,
   count(*) FILTER (marker = '-') OVER {_HUNK} AS n_old, count(*) FILTER (marker = '+') OVER {_HUNK} AS n_new FROM as3 LEFT JOIN sc USING (scan_id)),
o2 AS (SELECT * FROM as4 WHERE marker = '-'), n2 AS (SELECT * FROM as4 WHERE marker = '+'),
pa AS (SELECT n2.*, o2.line_idx AS old_idx, o2.value AS old_value,
   EXISTS (SELECT 1 FROM n2 q WHERE q.scan_id = n2.scan_id AND q.file_idx = n2.file_idx AND q.hunk_idx = n2.hunk_idx AND q.method = o2.method AND q.value = o2.value) AS old_in_new,
   EXISTS (SELECT 1 FROM o2 q WHERE q.scan_id = n2.scan_id AND q.file_idx = n2.file_idx AND q.hunk_idx = n2.hunk_idx AND q.method = n2.method AND q.value = n2.value) AS in_old
   FROM n2 JOIN o2 USING (scan_id, file_idx, hunk_idx, method) WHERE regexp_replace(n2.value, '[''"`\\s]', '', 'g') <> regexp_replace(o2.value, '[''"`\\s]', '', 'g')),
pk AS (SELECT *, CASE WHEN change = 'specific' THEN 'with_source' WHEN change = 'any' THEN 'other_source'
   WHEN regexp_matches(old_value, '^[''"`]') AND regexp_matches(old_value, '[''"`]$') AND regexp_matches(value, '^[a-zA-Z_$][a-zA-Z0-9_$.]*$') THEN 'refactored'
   WHEN old_in_new AND in_old THEN 'swapped' WHEN old_in_new AND n_new >= n_old THEN 'expanded' ELSE 'changed' END AS kind FROM pa),
d2 AS (SELECT {_out(0, 'old_idx', 'line_idx', conf="CASE WHEN kind IN ('with_source', 'refactored', 'expanded') THEN 'low' WHEN kind IN ('other_source', 'swapped') THEN 'medium' ELSE 'high' END")} FROM pk
   UNION ALL SELECT {_out(1, conf="CASE WHEN change = 'none' THEN 'medium' ELSE 'low' END", kind="'removed'")} FROM o2
   WHERE NOT (n_new >= n_old AND n_new > 0) AND NOT EXISTS (SELECT 1 FROM n2 q WHERE q.scan_id = o2.scan_id AND q.file_idx = o2.file_idx AND q.hunk_idx = o2.hunk_idx AND (q.method = o2.method OR q.value = o2.value)))"""

D3_SQL = f"""
m1 AS (SELECT *, {_TRIM('body')}[1:120] AS ev, count(*) OVER {_HUNK} AS n_lines FROM ({_FUNC}) WHERE is_test),
m2 AS (SELECT *, {by(R.MOCKS, lambda ps: 'CASE ' + ' '.join(f'WHEN {rx("raw", p)} THEN {i}' for i, p in enumerate(ps)) + ' END')} AS which FROM m1 WHERE marker = '+'),
m3 AS (SELECT scan_id, file_idx, hunk_idx, path, importance, new_start, n_lines, count(which) AS mocks, count(*) FILTER ({rx('raw', R.ANY_ASSERTION)}) AS checks FROM m2 GROUP BY ALL),
d3 AS (SELECT {_out(conf="CASE WHEN which IN (1, 2) THEN 'low' WHEN contains(raw, '* as') OR NOT contains(raw, '{') THEN 'high' ELSE 'medium' END", kind="'mock_' || least(which, 3)")} FROM m2 WHERE which IS NOT NULL
   UNION ALL SELECT {_out(1, '0', '0', 'new_start', '(new_start + n_lines)::INT', "'medium'", "'excessive'", "'Mocks: ' || mocks || ', Assertions: ' || checks")} FROM m3 WHERE checks > 0 AND mocks > checks)"""

_IMP = f"CASE WHEN {rx('path', R.TEST_FILE)} THEN 'test' WHEN {rx('path', R.SOURCE_FILE)} THEN 'source' WHEN {rx('path', R.CONFIG_FILE)} THEN 'config' ELSE 'docs' END AS importance"
_BOTS = ", ".join(map(diffs._lit, R.BOTS))
D4_SQL = f"""
f4 AS (SELECT scan_id, file_idx, path, non_functional, importance, count(*) FILTER (marker = '+') AS added,
   max((marker <> ' ' AND {_TRIM('body')} <> '' AND NOT {rx(_TRIM('body'), R.COSMETIC)})::INT) AS meaningful, {rx('path', R.TEST_FILE)} AS testish,
   {rx('path', R.SOURCE_FILE)} AND NOT {rx('path', R.TEST_FILE)} AND NOT non_functional AS sourceish FROM x GROUP BY ALL),
w4 AS (SELECT scan_id, count(*) FILTER (NOT non_functional) AS functional, count(*) FILTER (testish) AS tests, count(*) FILTER (sourceish) AS sources,
   string_agg(path, ', ' ORDER BY file_idx) AS all_paths, string_agg(path, ', ' ORDER BY file_idx) FILTER (sourceish) AS source_paths FROM f4 GROUP BY scan_id),
c4 AS (SELECT * FROM w4 JOIN change_sets USING (scan_id) WHERE {rx('pr_title', R.CLAIMS_TESTS)}),
k4 AS (SELECT scan_id, 0 AS file_idx, 0 AS hunk_idx, 0 AS phase, all_paths AS path, CASE WHEN pr_author IN ({_BOTS}) OR {rx('pr_title', R.HONEST_TITLE)} THEN 'low' ELSE 'medium' END AS conf, 'nothing_functional' AS kind FROM c4 WHERE functional = 0
   UNION ALL SELECT scan_id, 0, 0, 2, source_paths, 'medium', 'no_tests' FROM c4 WHERE sources > 0 AND tests = 0),
d4 AS (SELECT {_out('phase', '0', '0', '0', '0', ev='path').replace(', importance', '')}, {_IMP} FROM k4
   UNION ALL SELECT {_out(1, 'file_idx', '0', '0', '0', "'low'", "'cosmetic'", 'path').replace('hunk_idx', '0 AS hunk_idx', 1)} FROM f4 WHERE testish AND added >= 5 AND meaningful = 0)"""

D5_SQL = f"""
s1 AS (SELECT *, {_TRIM('body')} AS t FROM ({_FUNC}) WHERE NOT catch_exempt),
s2 AS (SELECT *, t[1:200] AS ev, CASE WHEN marker = '+' THEN CASE WHEN {by(R.CATCH_EMPTY, lambda p: rx('body', p))} THEN 'empty' WHEN {by(R.CATCH_TODO, lambda p: rx('body', p))} THEN 'todo'
   WHEN {by(R.CATCH_PRINT, lambda p: rx('body', p))} THEN 'console_only' WHEN {rx('body', R.CATCH_NULL)} THEN 'return_null' WHEN {rx('body', R.CATCH_COMMENT)} THEN 'comment_only' WHEN {rx('body', R.FINALLY_EMPTY)} THEN 'empty_finally' END END AS kind,
   CASE WHEN marker = '-' THEN '-' WHEN starts_with(t, '}}') THEN '}}' WHEN t IN ('', '{{') THEN '-' WHEN {rx('t', R.BODY_COMMENT)} THEN CASE WHEN {rx('t', R.UNFINISHED)} THEN 't' ELSE 'c' END WHEN {rx('t', R.BODY_PRINT)} THEN 'p' ELSE 'x' END AS code FROM s1),
s3 AS (SELECT *, string_agg(code, '') OVER (PARTITION BY scan_id, file_idx, hunk_idx ORDER BY line_idx ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS nxt FROM s2),
s4 AS (SELECT *, regexp_extract(nxt, '^([^}}]*)\\}}', 1) AS closing FROM s3),
s5 AS (SELECT *, CASE WHEN contains(closing, 't') THEN 'block_todo' WHEN contains(closing, 'p') THEN 'block_print' WHEN contains(closing, 'c') THEN 'block_comment' ELSE 'block_empty' END AS how FROM s4
   WHERE marker = '+' AND kind IS NULL AND {by(R.CATCH_OPEN, lambda p: rx('raw', p))} AND NOT {rx('t', R.NOT_CATCH)} AND coalesce(lang NOT IN ('python', 'ruby'), true) AND contains(nxt, '}}') AND NOT contains(closing, 'x')),
d5 AS (SELECT {_out(conf="CASE WHEN kind IN ('empty', 'return_null') THEN 'high' WHEN kind IN ('todo', 'comment_only') THEN 'medium' ELSE 'low' END")} FROM s4 WHERE kind IS NOT NULL
   UNION ALL SELECT {_out(1, end='(line_no + length(closing) + 1)::INT', conf="CASE WHEN how = 'block_empty' THEN 'high' ELSE 'medium' END", kind='how')} FROM s5)"""

_IN = lambda c, names: f"{c} IN ({', '.join(map(diffs._lit, names))})" if names else "false"
D6_SQL = f"""
h1 AS (SELECT *, {_TRIM('body')}[1:200] AS ev, regexp_extract_all({_TRIM('body')}, '\\.\\s*([a-zA-Z]+)\\s*\\(', 1) AS calls FROM ({_FUNC}) WHERE is_test AND marker = '+'),
h2 AS (SELECT *, unnest(calls) AS m, generate_subscripts(calls, 1) AS p FROM h1 WHERE len(calls) > 0 AND NOT {_IN('calls[1]', R.NOT_MATCHERS)}),
h3 AS (SELECT *, CASE WHEN {_IN('m', R.NOT_MATCHERS)} THEN NULL WHEN {_IN('m', R.INVENTED)} THEN 'invented' WHEN {rx('m', R.MATCHER_LIKE)} AND NOT coalesce({by(R.MATCHERS, lambda n: _IN('m', n))}, false) AND NOT {_IN('m', R.GLOBALS)} THEN 'unknown' END AS k FROM h2),
h4 AS (SELECT * FROM h3 WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scan_id, file_idx, hunk_idx, line_idx ORDER BY p) = 1),
d6 AS (SELECT {_out(conf="CASE WHEN k = 'invented' THEN 'high' ELSE 'low' END", kind='m')} FROM h4)"""

_INSTR = ", ".join(f"({n}, {diffs._lit(label)}, '{s}', {diffs._lit('(?i)' + p)})" for n, (label, s, p) in enumerate(R.INSTRUCTIONS))
D11_SQL = f"""
ir(n, label, severity, p) AS (VALUES {_INSTR}),
i1 AS (SELECT *, {_TRIM('body')} AS t FROM x WHERE is_agent AND marker = '+' AND path <> '/dev/null'),
i2 AS (SELECT i1.*, ir.* FROM i1 JOIN ir ON regexp_matches(t, p) WHERE t <> ''),
i3 AS (SELECT scan_id, file_idx, path, label, severity, count(*) AS c, min([hunk_idx, line_idx, n]) AS first FROM i2 GROUP BY ALL),
i4 AS (SELECT *, (row_number() OVER (PARTITION BY scan_id, file_idx ORDER BY first))::INT AS line_no, 0 AS hunk_idx, 'artifact' AS importance FROM i3),
d11 AS (SELECT {_out(0, 'line_no', '0', conf="CASE WHEN severity = 'high' AND c >= 2 THEN 'high' WHEN severity = 'high' OR (severity = 'medium' AND c >= 3) THEN 'medium' ELSE severity END", kind='label', ev="label || ' ' || c")} FROM i4)"""

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_INDENT = f"CASE WHEN length(ltrim(body, {_WS})) = 0 THEN -1 ELSE length(body) - length(ltrim(body, {_WS})) END"
_K = "scan_id, file_idx, hunk_idx"


def d10_sql(least: int) -> str:
    return f"""
a10 AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY line_idx) AS n, count(*) OVER {_HUNK} AS total FROM ({_FUNC}) WHERE is_test AND marker = '+' AND NOT starts_with(raw, '+++')),
b10 AS (SELECT {_K}, path, importance, n, total, {_INDENT} AS indent, {_RULE(R.FUNCTION_START, 'body')} AS fn, {_RULE(R.TEST_START, 'body')} AS ts, {_RULE(R.REGISTRY_ASSERTION, 'body')} OR {rx('body', R.LOOSE_ASSERTION)} AS asserts,
   {rx('body', R.NEGATIVE)} AS negative, {_RULE(R.MOCKS, 'body')} AS mock, {rx('body', R.GENERIC)} AS generic, {rx('body', R.EMPTY_CATCH_LINE)} AS empty_catch, {rx('body', R.CONDITIONAL)} AS cond, {rx('body', R.NEARBY_ASSERTION)} AS nearby,
   {_TRIM('body')} IN ('}}', 'end') OR {rx('body', chr(94) + chr(92) + 's*' + chr(92) + ')' + chr(92) + 's*;')} AS ends FROM a10 WHERE total >= {least}),
c10 AS (SELECT *, sum((fn OR ts)::INT) OVER (PARTITION BY {_K} ORDER BY n) AS block, sum(cond::INT) OVER (PARTITION BY {_K} ORDER BY n) AS part FROM b10),
e10 AS (SELECT *, max(CASE WHEN fn OR ts THEN indent END) OVER (PARTITION BY {_K}, block) AS base FROM c10),
f10 AS (SELECT *, block > 0 AND coalesce(max((NOT (fn OR ts) AND indent >= 0 AND indent < base)::INT) OVER (PARTITION BY {_K}, block ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS inside,
   coalesce(max(ends::INT) OVER (PARTITION BY {_K}, part ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS live FROM e10),
g10 AS (SELECT {_K}, path, importance, total, block, max((block > 0 AND fn)::INT) AS fn, count(*) FILTER (inside AND NOT (fn OR ts) AND asserts) AS asserts, max((inside AND NOT (fn OR ts) AND negative)::INT) AS negative, max((inside AND NOT (fn OR ts) AND mock)::INT) AS mock,
   count(*) FILTER (generic) AS generic, count(*) FILTER (empty_catch) AS empty_catch, min(n) FILTER (inside) AS first, max(n) FILTER (inside) AS last FROM f10 GROUP BY ALL),
h10 AS (SELECT {_K}, path, importance, total AS added, count(*) FILTER (block > 0) AS blocks, sum(fn) AS functions, sum(asserts) AS assertions, sum(negative) AS negatives, sum(mock) AS mocks, sum(generic) AS generics, sum(empty_catch) AS empty_catches,
   coalesce(min(first), 1) AS line_start, coalesce(max(last), any_value(total)) AS line_end FROM g10 GROUP BY ALL),
p10 AS (SELECT {_K}, part, min(n) AS cl, max((live AND nearby)::INT) AS asserted, min(n) FILTER (live AND ends) AS e FROM f10 WHERE part > 0 GROUP BY ALL),
q10 AS (SELECT {_K}, count(*) AS gaps, min_by('Conditional at line ' || cl || CASE WHEN e IS NULL THEN ' has no nearby assertion' ELSE ':' || e || ' has no assertion' END, cl) AS gap FROM p10 WHERE asserted = 0 GROUP BY ALL),
r10 AS (SELECT h10.*, coalesce(gaps, 0) AS gaps, gap, (assertions * 100 / added)::DOUBLE AS density, CASE WHEN added < 80 THEN 1.0 ELSE 2.0 END::DOUBLE AS ld, CASE WHEN added < 80 THEN 15 ELSE 30 END AS we, greatest(functions, 1)::DOUBLE AS fs FROM h10 LEFT JOIN q10 USING ({_K})),
s10 AS (SELECT *, least(100, CASE WHEN density < ld THEN floor(we * (1 - density / ld) + 0.5) ELSE 0 END + CASE WHEN added >= 80 AND negatives = 0 AND blocks > 0 THEN 25 ELSE 0 END + floor(20 * generics::DOUBLE / greatest(assertions, 1) + 0.5)
   + floor(15 * least(mocks / fs, 1) + 0.5) + CASE WHEN assertions / fs < 2 THEN floor(10 * (1 - assertions / fs / 2) + 0.5) ELSE 0 END)::INT AS score, floor(density * 10 + 0.5)::BIGINT AS tenths FROM r10),
t10 AS (SELECT {_K}, path, importance, added::INT AS added, blocks::INT AS blocks, functions::INT AS functions, assertions::INT AS assertions, negatives::INT AS negatives, mocks::INT AS mocks, generics::INT AS generics, line_start::INT AS line_start, line_end::INT AS line_end, gaps::INT AS gaps, score,
   CASE WHEN score >= 65 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'none' END AS confidence,
   concat_ws(chr(10), 'Vulnerability Score: ' || score || '/100', 'Assertion Density: ' || (tenths // 10) || CASE WHEN tenths % 10 > 0 THEN '.' || (tenths % 10) ELSE '' END || ' per 100 lines (threshold: 2)', 'Generic Matchers: ' || generics::BIGINT,
     'Negative Assertions: ' || negatives::BIGINT, 'Mock Usage: ' || mocks::BIGINT, 'Functions: ' || blocks, 'Coverage Gaps: ' || gap, CASE WHEN gaps > 1 THEN '  +' || (gaps - 1) || ' more gap(s)' END,
     CASE WHEN empty_catches > 0 THEN 'Empty Catch Blocks: ' || empty_catches::BIGINT || ' (mutations in try will survive)' END) AS evidence FROM s10),
d10 AS (SELECT {_K}, 0 AS phase, 0 AS i1, 0 AS i2, path, line_start, line_end, confidence, 'susceptible' AS kind, evidence, importance FROM t10 WHERE confidence <> 'none')"""


D10_SQL = d10_sql(50)

_END = lambda m, braces, plus: f"coalesce(CASE WHEN {braces} AND contains({m}.t, '{{') THEN (SELECT min(y.i) FROM l7 y WHERE y.scan_id = {m}.scan_id AND y.file_idx = {m}.file_idx AND y.hunk_idx = {m}.hunk_idx AND y.i > {m}.i AND y.cum - {m}.cum + {m}.net <= 0) END, (SELECT min(y.i) FROM l7 y WHERE y.scan_id = {m}.scan_id AND y.file_idx = {m}.file_idx AND y.hunk_idx = {m}.hunk_idx AND y.i > {m}.i AND y.t <> '' AND NOT starts_with(y.t, '#') AND y.indent < {m}.indent + {plus}), {m}.size)"


def d7b_sql(limited: bool) -> str:
    few = "c7 AS (SELECT scan_id FROM x WHERE NOT non_functional GROUP BY scan_id HAVING count(DISTINCT file_idx) <= 5),\n" if limited else ""
    semi = " SEMI JOIN c7 USING (scan_id)" if limited else ""
    return f"""
{few}l7 AS (SELECT *, sum(net) OVER (PARTITION BY {_K} ORDER BY line_idx) AS cum FROM (SELECT {_K}, path, lang, importance, line_idx, row_number() OVER (PARTITION BY {_K} ORDER BY line_idx) - 1 AS i, {_TRIM('body')} AS t, {_INDENT} AS indent, count(*) OVER {_HUNK} AS size,
   {_RULE(R.BODY_OPENERS, 'body')} AS opens, {rx(_TRIM('body'), R.NEVER_RUN)} AS never, length(body) - length(replace(body, '{{', '')) - length(body) + length(replace(body, '}}', '')) AS net
   FROM ({_FUNC}){semi} WHERE lang <> 'javascript' AND marker = '+' AND NOT starts_with(raw, '+++'))),
w7 AS (SELECT {_K} FROM l7 GROUP BY ALL HAVING length({_TRIM("string_agg(t, chr(10) ORDER BY i)")}) >= 10),
o7 AS (SELECT *, {_END('m', "lang IN ('go', 'java', 'rust', 'php')", "(CASE WHEN lang IN ('go', 'java', 'rust', 'php') THEN 0 ELSE 1 END)")} AS e FROM l7 m SEMI JOIN w7 USING ({_K}) WHERE opens),
k7 AS (SELECT {_K}, list_reduce(list_prepend([-1, 0], list([i, e] ORDER BY i)), lambda a, b: CASE WHEN b[1] >= a[-1] THEN list_concat(a, b) ELSE a END) AS fl FROM o7 GROUP BY ALL),
n7 AS (SELECT {_K}, unnest(range(3, len(fl) + 1, 2)) AS q, fl FROM k7), f7 AS (SELECT {_K}, fl[q] AS i, fl[q + 1] AS e FROM n7),
g7 AS (SELECT m.{_K.replace(', ', ', m.')}, m.path, m.importance, f7.i, f7.e FROM f7 JOIN l7 m ON m.scan_id = f7.scan_id AND m.file_idx = f7.file_idx AND m.hunk_idx = f7.hunk_idx AND m.i = f7.i
   WHERE f7.e > f7.i + 1 AND f7.e - f7.i <= 3 AND EXISTS (SELECT 1 FROM l7 y WHERE y.scan_id = m.scan_id AND y.file_idx = m.file_idx AND y.hunk_idx = m.hunk_idx AND y.i > f7.i AND y.i < f7.e AND {_RULE(R.TRIVIAL_VALUES, 't').replace("lang =", "y.lang =").replace("matches(t,", "matches(y.t,")})),
v7 AS (SELECT m.{_K.replace(', ', ', m.')}, path, importance, i, {_END('m', 'true', '0')} AS e FROM l7 m SEMI JOIN w7 USING ({_K}) WHERE never AND NOT opens
   AND NOT EXISTS (SELECT 1 FROM f7 y WHERE y.scan_id = m.scan_id AND y.file_idx = m.file_idx AND y.hunk_idx = m.hunk_idx AND y.i <= m.i AND m.i < y.e)),
d7b AS (SELECT {_K}, 0 AS phase, i::INT AS i1, 0 AS i2, path, (i + 1)::INT AS line_start, e::INT AS line_end, 'high' AS confidence, 'trivial_function' AS kind, 'Function at line ' || (i + 1) || ' returns trivial value unconditionally.' AS evidence, importance FROM g7
   UNION ALL SELECT {_K}, 0, i::INT, 0, path, (i + 1)::INT, e::INT, 'high', 'conditional_wrap', 'if(false) block at line ' || (i + 1), importance FROM v7)"""


D7B_SQL = d7b_sql(True)

_TOK, _FLAT = diffs._lit(S.TOKEN), "replace(sig, chr(10) || ' ', '')"


def _statements(sig: str) -> str:
    for pattern, to in zip(S.CARRIES, ("\\1", "\\1", "}~\\1"), strict=True):
        sig = f"regexp_replace({sig}, {diffs._lit(pattern)}, '{to}', 'g')"
    return f"len(list_filter(regexp_split_to_array({sig}, ';|\\n|\\}} '), lambda x: trim(x) <> ''))"


def d7a_sql(limited: bool) -> str:
    k = _K
    few = f"SEMI JOIN (SELECT scan_id FROM x WHERE NOT non_functional GROUP BY scan_id HAVING count(DISTINCT file_idx) <= {S.MOST_FILES}) USING (scan_id)" if limited else ""
    cut = f"code[1:{S.MOST_CHARS}]" if limited else "code"
    most = f"AND n <= {S.MOST_HUNKS} AND pieces <= {S.MOST_PIECES}" if limited else ""
    opens, closes = "tok IN ('(', '[', '{')", "tok IN (')', ']', '}')"
    lags = ", ".join(f"lag(tok, {n}) OVER o AS p{n}, lag(line, {n}) OVER o AS l{n}" for n in range(1, S.BEFORE + 1))
    controls = ", ".join(map(diffs._lit, S.NOT_FUNCTIONS))
    name = lambda c: f"regexp_matches({c}, '^[A-Za-z_$]') AND {c} NOT IN ({controls})"
    text = lambda kind, line: f"'{kind} at line ' || nos[{line} + 1]"
    hit = lambda no, cond, kind, conf, line, ev: f"SELECT {k}, path, importance, pos, {no} AS no, '{kind}' AS kind, '{conf}' AS conf, nos[{line} + 1] AS line_start, nos[end_line + 1] AS line_end, {ev} AS ev FROM yj WHERE {cond}"
    hits = [
        hit(0, "is_function AND trivial <> ''", "trivial_function", "high", "line", text("Function", "line") + " || ' returns ' || trivial || ' unconditionally.'"),
        hit(1, f"is_function AND regexp_matches(flat, {diffs._lit(S.FUNCTION_TRY)}) AND holds_silent", "async_gutted", "high", "line", text("Function", "line") + " || ' wraps logic in try/catch with no error handling.'"),
        hit(2, "is_function AND (flat = '' OR lone)", "empty_test_shell", "medium", "line", text("Function", "line") + " || ' has no meaningful body.'"),
        hit(3, "is_catch AND (n = 0 OR (n = 1 AND expression))", "async_gutted", "high", "try_line", text("Try/catch", "try_line") + " || CASE WHEN n = 0 THEN ' has empty catch body.' ELSE ' has comment-only catch body.' END"),
        hit(4, "tok = '(' AND p1 = 'if' AND flat = 'false'", "conditional_wrap", "high", "line", text("if(false) block", "line")),
        hit(5, "tok = '(' AND p1 = 'if' AND regexp_matches(flat, '^0+(?:\\.0*)?$')", "conditional_wrap", "high", "line", text("if(0) block", "line")),
        hit(6, f"tok = '(' AND p1 = 'if' AND regexp_matches(flat, {diffs._lit(S.SIMPLE_CONDITION)}) AND regexp_matches(flat[1:80], '{S.SKIPS}')", "conditional_wrap", "medium", "line", text("Conditional", "line") + " || ': ' || flat[1:80]"),
        hit(7, f"tok = '{{' AND p3 = 'switch' AND p1 = ')' AND has_default AND {_statements('rest')} <= 1", "conditional_wrap", "medium", "line", text("Switch", "line")),
    ]
    return f"""
ya AS (SELECT *, count(*) OVER {_HUNK} AS added, line_idx - row_number() OVER (PARTITION BY {k} ORDER BY line_idx) AS piece FROM ({_FUNC}) {few} WHERE lang = 'javascript' AND marker = '+' AND NOT starts_with(raw, '+++') AND {rx('path', R.TEST_FILE)}),
yb AS (SELECT {k}, path, importance, piece, string_agg(body, chr(10) ORDER BY line_idx) AS t, list(line_no ORDER BY line_idx) AS ls FROM ya WHERE added >= {S.LEAST_ADDED if limited else 1} GROUP BY ALL),
yc AS (SELECT {k}, path, importance, count(*) AS pieces, string_agg(t, chr(10) ORDER BY piece) FILTER (length({_TRIM('t')}) > {S.LEAST_PIECE}) AS code, flatten(list(ls ORDER BY piece) FILTER (length({_TRIM('t')}) > {S.LEAST_PIECE})) AS nos FROM yb GROUP BY ALL),
yd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY file_idx, hunk_idx) AS n FROM yc) WHERE code IS NOT NULL {most}),
ye AS (SELECT {k}, unnest(regexp_extract_all({cut}, {_TOK})) AS tok, generate_subscripts(regexp_extract_all({cut}, {_TOK}), 1) - 1 AS pos FROM yd),
yf AS (SELECT {k}, pos, tok, coalesce(sum(length(tok) - length(replace(tok, chr(10), ''))) OVER b, 0)::INT AS line, (coalesce(sum(({opens})::INT - ({closes})::INT) OVER b, 0) - ({closes})::INT)::INT AS level
   FROM ye WINDOW b AS (PARTITION BY {k} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
yg AS (SELECT {k}, pos, CASE WHEN left(tok, 1) IN (chr(39), '"', '`') AND length(tok) > 1 THEN '{S.STRING}' ELSE tok END AS tok, line, level FROM yf WHERE tok <> chr(10) AND NOT starts_with(tok, '//') AND NOT starts_with(tok, '/*')),
yh AS (SELECT * FROM (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY {k}, level ORDER BY pos) AS owner FROM (SELECT *, NULL::BIGINT AS mark FROM yg UNION ALL SELECT {k}, pos, tok, line, level + 1, pos FROM yg WHERE {opens})) WHERE mark IS NULL),
yi AS (SELECT *, coalesce(line > lag(line) OVER o, false) AS fresh, lead(tok) OVER o AS close, lead(line) OVER o AS end_line, {lags} FROM yh WINDOW o AS (PARTITION BY {k}, owner ORDER BY pos)),
ys AS (SELECT {k}, owner AS pos, string_agg(CASE WHEN fresh THEN chr(10) || ' ' ELSE '' END || tok, ' ' ORDER BY pos) AS sig FROM yi WHERE owner IS NOT NULL GROUP BY {k}, owner),
yk AS (SELECT yi.*, coalesce(sig, '') AS sig FROM yi LEFT JOIN ys USING ({k}, pos) WHERE tok || close IN ('()', '[]', '{{}}')),
yl AS (SELECT *, {_FLAT} AS flat, {_statements('sig')} AS n,
   coalesce(tok = '{{' AND (p1 = '=>' OR (p1 = ')' AND p2 = '(' AND {name('p3')}) OR (p2 = ':' AND p3 = ')' AND p4 = '(' AND {name('p5')})), false) AS is_function,
   coalesce(tok = '{{' AND ((p1 = 'catch' AND p4 = 'try') OR (p1 = ')' AND p3 = 'catch' AND p6 = 'try')), false) AS is_catch, CASE WHEN p1 = 'catch' THEN l4 ELSE l6 END AS try_line,
   regexp_extract(sig, '(?s)(?:^|\\n |[;}}] )default :(.*)$', 1) AS def, regexp_matches(sig, '(?:^|\\n |[;}}] )default :') AS has_default FROM yk),
ym AS (SELECT *, regexp_replace(def, '(?s)(?:^|\\n |[;}}] | )case .*$', '', 'g') AS rest, NOT regexp_matches(flat, {diffs._lit(f'^(?:{S.NOT_EXPRESSIONS})(?: |$)')}) AS expression, regexp_extract(flat, '^return (true|false|null|undefined)(?: ;)?$', 1) AS trivial,
   regexp_matches(flat, '^[A-Za-z_$][A-Za-z0-9_$]*(?: ;)?$') AND NOT regexp_matches(flat, '^(?:return|break|continue|debugger|this|true|false|null|super)(?: |$)') AS lone, max(CASE WHEN is_catch AND n <= 1 THEN owner END) OVER (PARTITION BY {k}, owner) AS silent_owner FROM yl),
yn AS (SELECT DISTINCT {k}, silent_owner AS pos FROM ym WHERE silent_owner IS NOT NULL),
yj AS (SELECT ym.*, path, importance, nos, yn.pos IS NOT NULL AS holds_silent FROM ym LEFT JOIN yn USING ({k}, pos) JOIN yd USING ({k})),
d7a AS (SELECT {k}, 0 AS phase, pos::INT AS i1, no::INT AS i2, path, line_start::INT AS line_start, line_end::INT AS line_end, conf AS confidence, kind, ev[1:200] AS evidence, importance FROM ({' UNION ALL '.join(hits)}))"""


_ALL = ", ".join([_BASE, D1_SQL, D2_SQL, D3_SQL, D4_SQL, D5_SQL, D6_SQL, D7B_SQL, D10_SQL, D11_SQL])
_TYPES = {"d1": 0, "d2": 1, "d3": 2, "d4": 3, "d5": 4, "d6": 5, "d7b": 7, "d10": 8, "d11": 9}
_PATTERN = {n: R.DETECTORS[0 if d == "d7b" else n] for d, n in _TYPES.items()}
_UNION = " UNION ALL ".join(f"SELECT *, {n} AS det, '{_PATTERN[n]}' AS pattern_type FROM {d}" for d, n in _TYPES.items())
FOUND_SQL = f"un AS ({_UNION}), found AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY det, file_idx, hunk_idx, phase, i1, i2) AS seq FROM un)"
_PEN = "CASE " + " ".join(f"WHEN pattern_type = '{k}' THEN CASE confidence WHEN 'high' THEN {a} WHEN 'medium' THEN {b} ELSE {c} END" for k, (a, b, c) in R.PENALTIES["engine"].items()) + " ELSE CASE confidence WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 2 END END"
_MUL = "CASE importance " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.MULTIPLIERS.items()) + " ELSE 1.0 END"
SCORE_SQL = f"""
dd AS (SELECT * EXCLUDE (seq), first_seq FROM (SELECT *, min(seq) OVER (PARTITION BY scan_id, path, line_start) AS first_seq,
   row_number() OVER (PARTITION BY scan_id, path, line_start ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, seq) AS rn FROM found) WHERE rn = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY scan_id, path, pattern_type ORDER BY first_seq) AS rank, min(first_seq) OVER (PARTITION BY scan_id, path, pattern_type) AS cluster_seq, {_PEN} AS base FROM dd),
fu AS (SELECT *, ((CASE WHEN rank > 1 AND confidence <> 'high' THEN CASE WHEN rank <= 5 THEN floor(base * 0.5 + 0.5) ELSE floor(base * 0.25 + 0.5) END ELSE base END)::DOUBLE * ({_MUL})::DOUBLE) AS penalty FROM rk),
su AS (SELECT scan_id, count(*) AS n, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low,
   floor(list_reduce(list_prepend(0::DOUBLE, list(penalty ORDER BY cluster_seq, rank)), lambda a, b: a + b) + 0.5)::INT AS penalty FROM fu GROUP BY scan_id),
ra AS (SELECT scan_id, count(*) AS raw FROM found GROUP BY scan_id), fc AS (SELECT scan_id, count(DISTINCT file_idx) AS files_scanned FROM lines GROUP BY scan_id),
j1 AS (SELECT scan_id, coalesce(raw, 0)::INT AS raw_findings, coalesce(n, 0)::INT AS findings, coalesce(high, 0)::INT AS high_count, coalesce(medium, 0)::INT AS medium_count, coalesce(low, 0)::INT AS low_count,
   coalesce(files_scanned, 0)::INT AS files_scanned, coalesce(penalty, 0)::INT AS penalty FROM change_sets LEFT JOIN fc USING (scan_id) LEFT JOIN su USING (scan_id) LEFT JOIN ra USING (scan_id)),
j2 AS (SELECT *, CASE WHEN files_scanned = 0 THEN 100 ELSE least(greatest(CASE WHEN findings > 0 THEN 30 ELSE 0 END, 100 - least(penalty, 85)), CASE WHEN high_count >= 2 THEN 40 WHEN high_count = 1 THEN 60 WHEN medium_count >= 3 THEN 70 ELSE 100 END) END::INT AS trust_score FROM j1),
j3 AS (SELECT *, CASE WHEN files_scanned > 0 THEN CASE WHEN trust_score >= 80 AND high_count = 0 THEN 'CLEAN' WHEN trust_score >= 50 THEN 'SUSPICIOUS' ELSE 'LIKELY_DECEPTIVE' END END AS verdict FROM j2)"""

#: The last step from scores to verdicts.
_VERDICTS = """SELECT *, CASE verdict WHEN 'CLEAN' THEN CASE WHEN trust_score >= 95 THEN 'high' WHEN trust_score >= 88 THEN 'medium' ELSE 'low' END
      WHEN 'SUSPICIOUS' THEN CASE WHEN trust_score >= 80 OR trust_score <= 60 THEN 'high' ELSE 'medium' END WHEN 'LIKELY_DECEPTIVE' THEN CASE WHEN trust_score <= 30 THEN 'high' ELSE 'medium' END END AS verdict_confidence, trust_score >= 70 AS passed FROM j3"""
_SYNTAX = f" UNION ALL SELECT *, {R.DETECTORS.index('syntax')} AS det, CASE WHEN kind = 'async_gutted' THEN 'silent_catch_and_pass' ELSE 'disabled_assertion' END AS pattern_type FROM d7a"
_VALID = f"""v AS (SELECT scan_id, raw_diff, {_TRIM("string_split(regexp_replace(raw_diff, '[ " + chr(92) + "t" + chr(92) + "n" + chr(92) + "x0B" + chr(92) + "f" + chr(92) + "r]+$', ''), chr(10))[-1]")} AS last FROM change_sets),
  valid AS (SELECT scan_id, length({_TRIM('raw_diff')}) >= 20 AND contains(raw_diff, 'diff --git ') AND regexp_matches(raw_diff, '@@ -\\d+(?:,\\d+)? \\+\\d+(?:,\\d+)? @@') AND NOT starts_with(last, '@@')
        AND NOT starts_with(last, 'diff --git') AND NOT contains(last, '[truncated]') AND (starts_with(last, '+') OR starts_with(last, '-')) AS valid,
        len(regexp_extract_all(raw_diff, '(?m)^diff --git'))::INT AS n_files FROM v)"""
_STRICT_BASE = f"{change_sets.EXACT_SQL}, {_VALID}, {strict.LINES_SQL}, {diffs.FILES_SQL}"
_AFTER_DEDUP = SCORE_SQL[SCORE_SQL.index("rk AS"):]


def _again(suffix: str, deduped: str) -> str:
    """The steps from deduplicated findings to verdicts under other names."""
    steps = _AFTER_DEDUP.replace("FROM dd)", f"FROM {deduped})").replace("FROM found GROUP", f"FROM {deduped} GROUP")
    for name in ("rk", "fu", "su", "ra", "fc", "j1", "j2", "j3"):
        steps = re.sub(rf"\b{name}\b", f"{name}{suffix}", steps)
    return steps


_STAGED = f"""WITH {_ALL}, {FOUND_SQL}, {SCORE_SQL[:SCORE_SQL.index('rk AS')]} {_again('_a', 'dd')},
hk AS (SELECT scan_id, file_idx, path, hunk_idx, '@@ -1,' || count(*) || ' +' || new_start || ',' || count(*) || ' @@' || chr(10) || string_agg(raw, chr(10) ORDER BY line_idx) AS t FROM lines GROUP BY scan_id, file_idx, path, hunk_idx, new_start),
hf AS (SELECT scan_id, file_idx, path, 'diff --git a/' || path || ' b/' || path || chr(10) || string_agg(t, chr(10) ORDER BY hunk_idx) AS t FROM hk GROUP BY scan_id, file_idx, path),
hs AS (SELECT scan_id, string_agg(t, chr(10) ORDER BY file_idx) AS t, arg_min(path, file_idx) AS first_path, max(regexp_matches(path, '{stages.TEST_FILES}')::INT) AS tests FROM hf GROUP BY scan_id),
ha AS (SELECT scan_id, first_path, tests, sha256(CASE WHEN length(t) > {stages.MOST_DIFF} THEN t[1:{stages.MOST_DIFF}] || '{stages.CUT}' ELSE t END) AS hash FROM hs),
ai AS (SELECT scan_id, 'ai_assisted_detection' AS pattern_type, first_path AS path, 1 AS line_start, 'high' AS confidence, NULL::VARCHAR AS importance, (1::BIGINT << 40) AS first_seq FROM ha WHERE {_DIGIT} <= '5' AND tests = 1
  UNION ALL SELECT scan_id, 'ai_assisted_detection', 'src/cart.ts', 7, CASE WHEN {_DIGIT} > '2' THEN 'low' WHEN tests = 1 THEN 'high' ELSE 'medium' END, NULL, (1::BIGINT << 40) + tests FROM ha WHERE {_DIGIT} <= '5'),
jv AS (SELECT scan_id, pattern_type, path, line_start, confidence, importance, first_seq, {VERDICT} AS verdict FROM (SELECT *, sha256(concat_ws('|', pattern_type, path, line_start, kind)) AS hash FROM dd)),
nw AS (SELECT scan_id, pattern_type, path, line_start, CASE WHEN verdict = 'CONTEXTUAL' THEN CASE confidence WHEN 'high' THEN 'medium' ELSE 'low' END ELSE confidence END AS confidence, importance, first_seq FROM jv WHERE verdict IS NULL OR verdict <> 'FALSE_POSITIVE' UNION ALL SELECT * FROM ai),
{_again('_b', 'nw')},
tc AS (SELECT DISTINCT scan_id FROM (SELECT scan_id FROM jv WHERE verdict IN ('FALSE_POSITIVE', 'CONTEXTUAL') UNION ALL SELECT scan_id FROM ai)),
lt AS (SELECT scan_id, count(*) AS n FROM d7b GROUP BY scan_id), nn AS (SELECT scan_id, count(*) AS n FROM nw GROUP BY scan_id)
SELECT a.scan_id, a.trust_score AS static_score, CASE WHEN tc.scan_id IS NULL THEN a.findings ELSE b.findings END AS findings, CASE WHEN tc.scan_id IS NULL THEN a.high_count ELSE b.high_count END AS high_count,
  CASE WHEN tc.scan_id IS NULL THEN a.trust_score ELSE b.trust_score END AS trust_score, CASE WHEN tc.scan_id IS NULL THEN a.verdict ELSE b.verdict END AS verdict, (coalesce(nn.n, 0) + coalesce(lt.n, 0))::INT AS listed,
  greatest(a.findings - coalesce(nn.n, 0) - coalesce(lt.n, 0), 0)::INT AS judge_filtered, 0 AS ai_assisted
FROM j3_a a JOIN j3_b b USING (scan_id) LEFT JOIN tc USING (scan_id) LEFT JOIN nn USING (scan_id) LEFT JOIN lt USING (scan_id)"""
_D = lambda ctes, name: f"WITH {_BASE}, {ctes} SELECT scan_id, file_idx, hunk_idx, phase, i1, i2, path, line_start, line_end, confidence, kind, evidence, importance FROM {name}"
ORACLE_SQL = {
    "src_diff_lines": f"WITH {_BASE} SELECT scan_id, file_idx, path, lang, is_test, non_functional, catch_exempt, is_agent, importance, hunk_idx, new_start, line_idx, marker, raw, body, line_no FROM x",
    "src_diff_files": f"WITH {_BASE} SELECT scan_id, file_idx, path, lang, is_test, non_functional, catch_exempt, is_agent, importance, count(*) FILTER (marker = '+') AS added, count(*) FILTER (marker = '-') AS removed FROM x GROUP BY ALL",
    "src_looks_valid": f"WITH {change_sets.SQL}, {_VALID} SELECT scan_id, valid, n_files FROM valid",
    "src_viewer_lines": f"""WITH {change_sets.SQL}, rw AS (SELECT scan_id, unnest(string_split(raw_diff, chr(10))) AS raw, generate_subscripts(string_split(raw_diff, chr(10)), 1) - 1 AS pos FROM change_sets),
      kd AS (SELECT *, CASE WHEN regexp_matches(raw, '{diffs.HUNK}') THEN 'header' WHEN regexp_matches(raw, '^(diff |index |--- |\\+\\+\\+ )') THEN 'info' WHEN starts_with(raw, '+') THEN 'add' WHEN starts_with(raw, '-') THEN 'remove' ELSE 'context' END AS kind FROM rw),
      hk AS (SELECT *, sum((kind = 'header')::INT) OVER (PARTITION BY scan_id ORDER BY pos) AS hunk FROM kd),
      bs AS (SELECT *, max(CASE WHEN kind = 'header' THEN regexp_extract(raw, '{diffs.HUNK}', 1)::INT END) OVER (PARTITION BY scan_id, hunk) AS ob, max(CASE WHEN kind = 'header' THEN regexp_extract(raw, '{diffs.HUNK}', 3)::INT END) OVER (PARTITION BY scan_id, hunk) AS nb,
        coalesce(count(*) FILTER (kind IN ('remove', 'context')) OVER r, 0) AS so, coalesce(count(*) FILTER (kind IN ('add', 'context')) OVER r, 0) AS sn FROM hk WINDOW r AS (PARTITION BY scan_id, hunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT scan_id, pos::INT AS pos, kind, CASE WHEN kind IN ('remove', 'context') THEN (ob + so)::INT END AS old_no, CASE WHEN kind IN ('add', 'context') THEN (nb + sn)::INT END AS new_no FROM bs WHERE hunk > 0""",
    "d1_disabled_assertions": _D(D1_SQL, "d1"),
    "d2_tampered_assertions": _D(D2_SQL, "d2"),
    "d3_mocks": _D(D3_SQL, "d3"),
    "d4_claim_mismatch": _D(D4_SQL, "d4"),
    "d5_silent_catches": _D(D5_SQL, "d5"),
    "d6_invented_matchers": _D(D6_SQL, "d6"),
    "d7b_trivial_bodies": _D(d7b_sql(False), "d7b"),
    "d7a_syntax_findings": _D(d7a_sql(False), "d7a"),
    "d10_susceptible_hunks": f"WITH {_BASE}, {D10_SQL} SELECT {_K}, path, importance, added, blocks, functions, assertions, negatives, mocks, generics, line_start, line_end, gaps, score, confidence, evidence FROM t10",
    "d11_agent_instructions": _D(D11_SQL, "d11"),
    "findings": f"WITH {_ALL}, {FOUND_SQL} SELECT scan_id, seq, pattern_type, path, line_start, line_end, confidence, kind, importance FROM found",
    "deduped_findings": f"WITH {_ALL}, {FOUND_SQL}, {SCORE_SQL} SELECT scan_id, path, line_start, pattern_type, confidence, first_seq, rank, base, penalty FROM fu",
    "sc_staged_scores": _STAGED,
    "ev_score_labels": f"""WITH {_ALL}, {FOUND_SQL}, {SCORE_SQL} SELECT scan_id, CASE WHEN findings = 0 AND trust_score >= 80 THEN 'CONFIRMED_LEGIT' ELSE 'PENDING_REVIEW' END AS label,
      CASE WHEN findings = 0 AND trust_score >= 80 THEN 'high' ELSE 'low' END AS confidence, CASE WHEN findings = 0 THEN CASE WHEN trust_score >= 80 THEN 'clean' ELSE 'anomaly' END WHEN trust_score >= 70 AND findings <= 2 THEN 'maybe_false' ELSE 'manual' END AS reason,
      CASE WHEN trust_score <= 20 THEN 20 WHEN trust_score <= 40 THEN 40 WHEN trust_score <= 60 THEN 60 WHEN trust_score <= 80 THEN 80 ELSE 100 END AS up_to FROM j3""",
    "src_strict_lines": f"WITH {_STRICT_BASE} SELECT x.scan_id, file_idx, path, lang, is_test, non_functional, catch_exempt, is_agent, importance, hunk_idx, new_start, line_idx, marker, raw, body, line_no, scan_id IN (SELECT scan_id FROM a9 WHERE strict) AS strict FROM x",
    "strict_trust_scores": f"WITH {_ALL.replace(_BASE, _STRICT_BASE)}, {FOUND_SQL}, {SCORE_SQL} {_VERDICTS}",
    "trust_scores": f"WITH {_ALL}, {FOUND_SQL}, {SCORE_SQL} {_VERDICTS}",
    "syntax_trust_scores": f"WITH {_ALL}, {d7a_sql(True)}, {FOUND_SQL.replace(_UNION, _UNION + _SYNTAX)}, {SCORE_SQL} {_VERDICTS}",
}
