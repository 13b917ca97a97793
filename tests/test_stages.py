"""Stages between which a model answers."""

import json

from pyspark.sql import functions as F

from hunkflow.operators import scoring, stages
from hunkflow.sources import diffs
from tests.test_diffs import diff, scans


def test_requests_are_asked_once(spark, tmp_path):
    path, asked = str(tmp_path / "answers"), []

    def ask(requests):
        asked.append(sorted(r.request for r in requests.collect()))
        return requests.withColumn("answer", F.upper("request"))

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "k int, request string")
    got = {r.k: r.answer for r in stages.answered(rows, path, ask).collect()}
    assert got == {1: "A", 2: "B", 3: "A", 4: None} and asked == [["a", "b"]]
    more = spark.createDataFrame([(5, "b"), (6, "c")], "k int, request string")
    assert {r.k: r.answer for r in stages.answered(more, path, ask).collect()} == {5: "B", 6: "C"} and asked[1:] == [["c"]]
    # a run that failed before it was read wrote its answers; they count once
    spark.read.parquet(path).write.mode("append").parquet(path + "2")
    spark.read.parquet(path).write.mode("append").parquet(path + "2")
    assert stages.answered(more, path + "2", ask).count() == 2


def test_shown_diffs(spark):
    two = diff("a.ts", "+x", " y", start=7) + "\n" + diff("b.ts", "-" + "z" * 9000)
    lines = diffs.parse_lines(scans(spark, two))
    assert stages.shown_diffs(lines, None).first().request == "diff --git a/a.ts b/a.ts\n@@ -1,2 +7,2 @@\n+x\n y\ndiff --git a/b.ts b/b.ts\n@@ -1,1 +1,1 @@\n-" + "z" * 9000
    cut = stages.shown_diffs(lines).first().request
    assert len(cut) == 8000 + len(stages.CUT) and cut.endswith("z\n... [truncated]")


def test_answers_become_findings(spark):
    lines = diffs.parse_lines(scans(spark, diff("src/a.ts", "+x"), diff("a.test.ts", "+x")))
    some = [{"pattern": "test_silencing", "severity": "high"}, {"pattern": "semantic_bypass", "severity": "high", "explanation": "e"}, {"pattern": "x", "severity": "?", "filePath": "q.ts", "lineStart": 3, "lineEnd": 4}]
    answer = json.dumps({"hasCheating": True, "findings": some})
    rows = stages.assisted(spark.createDataFrame([(0, answer), (1, answer)], "scan_id long, answer string"), lines).orderBy("scan_id", "idx").collect()
    assert [(r.scan_id, r.path, r.line_start, r.line_end, r.confidence) for r in rows] == [
        (0, "src/a.ts", 1, 4, "medium"), (0, "q.ts", 3, 4, "low"), (1, "a.test.ts", 1, 4, "high"), (1, "a.test.ts", 6, 9, "high"), (1, "q.ts", 3, 4, "low"),
    ]
    assert rows[0].evidence == "File: src/a.ts\nLine: 1-4\nIssue: e"
    bad = [(0, "no JSON"), (1, json.dumps({"hasCheating": False, "findings": some})), (0, None), (1, "{}"), (1, json.dumps({"hasCheating": True, "findings": None}))]
    assert stages.assisted(spark.createDataFrame(bad, "scan_id long, answer string"), lines).count() == 0


def test_only_touched_scans_are_scored_again(spark):
    schema = "scan_id long, pattern_type string, path string, line_start int, confidence string, importance string, kind string, seq int"
    rows = [(s, "silent_catch_and_pass", "a.ts", n, "medium", "source", "empty", n) for s in range(4) for n in range(1, 5)]
    deduped = scoring.dedup(spark.createDataFrame(rows, schema))
    verdict = F.when((F.col("scan_id") == 1) & (F.col("line_start") < 4), "FALSE_POSITIVE").when(F.col("scan_id") == 2, "CONTEXTUAL").otherwise("VALID")
    found = spark.createDataFrame([(3, 0, "ai_assisted_detection", "a.ts", 1, "high")] * 2, "scan_id long, idx int, pattern_type string, path string, line_start int, confidence string")
    late = spark.createDataFrame([(0, 2)], "scan_id long, n long")
    all_scans = spark.range(5).withColumnRenamed("id", "scan_id")
    out = {r.scan_id: r for r in stages.staged_scores(deduped, deduped.withColumn("verdict", verdict), found, late, all_scans, all_scans.withColumn("files_scanned", F.lit(1))).collect()}
    assert out[0].trust_score == out[0].static_score and (out[0].listed, out[0].findings, out[0].judge_filtered) == (6, 4, 0)
    assert out[1].trust_score > out[1].static_score and (out[1].listed, out[1].findings) == (1, 1)
    assert out[2].trust_score > out[2].static_score and out[2].findings == 4
    # what is found twice counts twice: nothing is deduplicated again
    assert (out[3].findings, out[3].high_count, out[3].trust_score, out[3].verdict) == (6, 2, 40, "LIKELY_DECEPTIVE")
    assert (out[4].trust_score, out[4].listed) == (100, 0) and {r.ai_assisted for r in out.values()} == {0}
