"""Change sets of our own with the exact scores they must get, end to end."""

from hunkflow.operators import evaluate
from hunkflow.plans import scan
from hunkflow.sources import strict
from tests.test_diffs import diff

T, S = "src/tests/a.test.ts", "src/a.ts"
#: (diff, title, score, verdict, its confidence, findings)
CASES = [
    ("", None, 100, None, None, 0),
    (diff(S, "+export const a = 1"), None, 100, "CLEAN", "high", 0),
    (diff(T, "+it('adds', () => {", "+  expect(a).toBe(1)", "+})"), None, 100, "CLEAN", "high", 0),
    # weak findings cost nothing, and none of them bars the way up
    (diff(T, "+test.todo('later')"), None, 100, "CLEAN", "high", 1),
    (diff(T, "+it.skip('slow on ci', fn)"), None, 100, "CLEAN", "high", 1),
    # one strong finding ends at 60, two at 40
    (diff(T, "+it.skip(name, fn)"), None, 60, "SUSPICIOUS", "high", 1),
    (diff(S, "+try { f() } catch (e) {}"), None, 60, "SUSPICIOUS", "high", 1),
    (diff(T, "+expect(a).toNotExist()"), None, 60, "SUSPICIOUS", "high", 1),
    (diff(T, "+it.skip(name, fn)", "+expect(a).toNotExist()"), None, 40, "LIKELY_DECEPTIVE", "medium", 2),
    (diff(T, "+it.only('a', fn)") + "\n" + diff(S, "+try { f() } catch (e) {}"), None, 40, "LIKELY_DECEPTIVE", "medium", 2),
    # medium ones: 2, then the second of a kind counts half; from three on 70 is the most
    (diff(T, "+it('a', () => {})"), None, 98, "CLEAN", "high", 1),
    (diff(T, "+it('a', () => {})", "+", "+", "+it('b', () => {})"), None, 97, "CLEAN", "high", 2),
    (diff(T, "+it('a', () => {})", "+", "+", "+it('b', () => {})", "+", "+", "+it('c', () => {})"), None, 70, "SUSPICIOUS", "medium", 3),
    # a title that claims tests costs nothing by itself
    (diff(S, "+export const a = 1"), "test: cover the cart", 100, "CLEAN", "high", 1),
    # what a change set registers itself is not invented
    (diff(T, "+expect.extend({ toBeShiny(x) { return x } })", "+expect(x).toBeShiny()"), None, 100, "CLEAN", "high", 0),
]


def test_golden_cases(spark):
    rows = [(i, d, title, "ann") for i, (d, title, *_) in enumerate(CASES)]
    scans = spark.createDataFrame(rows, "scan_id long, raw_diff string, pr_title string, pr_author string")
    got = {r.scan_id: (r.trust_score, r.verdict, r.verdict_confidence, r.findings) for r in scan.scores_of(strict.parse(scans).drop("strict"), scans).collect()}
    assert got == {i: tuple(want) for i, (_, _, *want) in enumerate(CASES)}


def test_auto_labels(spark):
    rows = spark.createDataFrame([(0, 100), (0, 60), (2, 70), (3, 90), (1, 40)], "n int, s int")
    labels = rows.select("n", "s", evaluate.auto_label(rows["n"], rows["s"]).alias("l")).collect()
    assert {(r.n, r.s): tuple(r.l) for r in labels} == {
        (0, 100): ("CONFIRMED_LEGIT", "high", "clean"), (0, 60): ("PENDING_REVIEW", "low", "anomaly"), (2, 70): ("PENDING_REVIEW", "low", "maybe_false"),
        (3, 90): ("PENDING_REVIEW", "low", "manual"), (1, 40): ("PENDING_REVIEW", "low", "manual"),
    }


def test_import_labels(spark):
    known = spark.createDataFrame([("gt_0041", "https://github.com/a/b/pull/1"), ("odd", "u")], "id string, url string")
    rows = [(0, " https://github.com/a/b/pull/1 ", "AMBIGUOUS", "", ""), (1, "https://github.com/c/d/pull/2", " confirmed_legit", "n", None), (2, "x", "LEGIT", "", ""), (3, "", "AMBIGUOUS", "", ""), (4, None, None, None, None), (5, "https://github.com/e/f/pull/3", "AMBIGUOUS", "", "own/repo")]
    new, counts = evaluate.import_labels(known, spark.createDataFrame(rows, "line int, url string, label string, notes string, repo string"), ["line"])
    assert [tuple(r) for r in new.orderBy("id").collect()] == [("gt_0042", "c/d", "https://github.com/c/d/pull/2", "CONFIRMED_LEGIT", "n"), ("gt_0043", "own/repo", "https://github.com/e/f/pull/3", "AMBIGUOUS", "")]
    assert {r.state: r.n for r in counts.collect()} == {"new": 2, "skipped": 3, "invalid": 1}
    assert evaluate.import_labels(known.where("false"), spark.createDataFrame(rows[1:2], "line int, url string, label string, notes string, repo string"), ["line"])[0].first().id == "gt_0001"
