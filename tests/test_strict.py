"""The strict reading of diffs against a plain reader of our own."""

import random
import re

from hunkflow.sources import strict
from tests.test_diffs import scans

HEADER = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
FILE_LINE = re.compile(r"^(?:Index:\s|diff\s|---\s|\+\+\+\s|={67})")


def read(text):
    """(file, path, hunk, start, line) of each line, or None if promises break."""
    lines, i, out, file, hunk, name = text.split("\n"), 0, [], 0, 0, None
    while i < len(lines):
        while i < len(lines) and not re.match(r"(---|\+\+\+|@@)\s", lines[i]):
            i += 1
        file, name = file + 1, {}
        for _ in range(2):
            if i < len(lines) and (m := re.match(r"(---|\+\+\+)\s+([^\r]*)", lines[i])):
                name[m[1]] = m[2].split("\t")[0].strip('"')
                i += 1
        while i < len(lines):
            if FILE_LINE.match(lines[i]):
                break
            if lines[i].startswith("@@"):
                m = HEADER.match(lines[i])
                if not m:
                    return None
                old, start, new = int(m[2] or 1), int(m[3]), int(m[4] or 1)
                i, hunk, olds, news, n = i + 1, hunk + 1, 0, 0, 0
                start += new == 0
                while i < len(lines) and (olds < old or news < new or lines[i].startswith("\\")):
                    op = " " if lines[i] == "" and i < len(lines) - 1 else lines[i][:1]
                    if op not in ("+", "-", " ", "\\"):
                        return None
                    olds, news = olds + (op in "- "), news + (op in "+ ")
                    out.append((file, name.get("+++", name.get("---", "unknown")), hunk, start, n, lines[i]))
                    i, n = i + 1, n + 1
                if (olds, news) != (0 if old == 1 and not olds else old, 0 if new == 1 and not news else new):
                    return None
            elif lines[i]:
                return None
            else:
                i += 1
    return out


def _random_diff(rng):
    out = []
    for f in range(rng.randrange(1, 4)):
        head = [f"diff --git a/f{f}.ts b/f{f}.ts", "index 1..2", f"--- a/f{f}.ts", f"+++ b/f{f}.ts"]
        out += rng.choice([head, head, head[2:], ["Index: f", *head[2:]], ["rename from x", *head]]) if f or rng.random() < 0.9 else head[:1]
        for _ in range(rng.randrange(0, 3)):
            body = [rng.choice(["+a", "-b", " c", "--- a", "+++ b", "", "-", "+", "@", "\\ No newline at end of file"] if rng.random() < 0.95 else ["x", "diff --git a/q b/q", "@@ -1 +1 @@"]) for _ in range(rng.randrange(0, 6))]
            old, new = sum(x[:1] in ("-", " ", "") for x in body), sum(x[:1] in ("+", " ", "") for x in body)
            if rng.random() < 0.1:
                old += 1
            short = lambda n: "" if n == 1 and rng.random() < 0.7 else f",{n}"
            out += [f"@@ -3{short(old)} +{rng.randrange(1, 9)}{short(new)} @@ code", *body]
        out += rng.choice([[], [], [""]])
    return "\n".join([*out, rng.choice(["+end", "-end", ""])]) if rng.random() < 0.3 else "\n".join(out)


def test_random_diffs(spark):
    rng = random.Random(12)
    texts = [_random_diff(rng) for _ in range(400)]
    rows = strict.marked_lines(scans(spark, *texts)).orderBy("scan_id", "pos").collect()
    valid = {r.scan_id for r in strict.parse(scans(spark, *texts)).where("strict").collect()}
    bad = {i for i in range(len(texts)) if read(texts[i]) is None}
    assert 50 < len(bad) < 350
    for i, text in enumerate(texts):
        mine = [r for r in rows if r.scan_id == i]
        want = read(text)
        looks = mine[0].strict
        if want is None:
            assert not looks, text
        elif looks:
            got = [(r.path, r.seg, r.start, r.idx - 1, r.raw) for r in mine if r.consumed]
            assert got == [w[1:] for w in want], text
            files = [r.file for r in mine if r.consumed]
            assert [files.index(f) for f in files] == [[w[0] for w in want].index(w[0]) for w in want], text
            assert bool(got) == (i in valid)


def test_paths_and_lines(spark):
    head = ["diff --git a/src/math.ts b/src/math.ts", "index 1..2 100644", "--- a/src/math.ts", "+++ b/src/math.ts\t2024"]
    one = "\n".join([*head, "@@ -1,3 +7,3 @@", " a", "--- b", "+++ c", " d"])  # lines of a hunk that look like names
    gone = "\n".join(["diff --git a/x.ts b/x.ts", "--- a/x.ts", "+++ /dev/null", "@@ -1,2 +0,0 @@", "-a", "-b"])
    off = one.replace("-1,3", "-1,4")
    quoted = "\n".join(["diff --git a/q b/q", '--- "a/q r.ts"', '+++ "b/q r.ts"', "@@ -1 +1 @@", "-a", "\\ No newline at end of file", "+b"])
    bare = "@@ -1,3 +5,3 @@\n+x\n@@ -9,9 +9,9 @@\n y\n-z"
    rows = strict.parse(scans(spark, one, gone, off, quoted, bare, None, "  ")).orderBy("scan_id", "file_idx", "hunk_idx", "line_idx").collect()
    got = lambda i: [(r.strict, r.path, r.line_no, r.marker, r.body) for r in rows if r.scan_id == i]
    assert got(0) == [(False, "src/math.ts", 7, " ", "a"), (False, "src/math.ts", 8, " ", "d")]  # ends with a line of context
    assert got(1) == [(True, "/dev/null", 1, "-", "a"), (True, "/dev/null", 2, "-", "b")]
    assert [x[0] for x in got(2)] == [False, False]
    assert got(3) == [(True, "b/q r.ts", 1, "-", "a"), (True, "b/q r.ts", 2, "\\", " No newline at end of file"), (True, "b/q r.ts", 3, "+", "b")]
    assert got(4) == [(False, "unknown", 1, " ", "y"), (False, "unknown", 2, "-", "z")] and not got(5) and not got(6)
    ended = strict.parse(scans(spark, one.replace(" d", "+d").replace("+7,3", "+7,3").replace("-1,3", "-1,2"))).orderBy("line_idx").collect()
    assert [(r.strict, r.path, r.line_no, r.marker, r.body) for r in ended] == [(True, "b/src/math.ts", 7, " ", "a"), (True, "b/src/math.ts", 8, "-", "-- b"), (True, "b/src/math.ts", 9, "+", "++ c"), (True, "b/src/math.ts", 10, "+", "d")]


def test_strict_lines_are_written_once(spark):
    """The result holds no window of the strict reading, only the tolerant one's."""
    from hunkflow.sources import strict

    good = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1 +1 @@\n-one\n+two"
    rows = spark.createDataFrame([(1, good), (2, good.replace("-1 +1", "-1,9 +1,9")), (3, None), (4, " ")], "scan_id int, raw_diff string")
    lines = strict.parse(rows)
    assert lines._jdf.queryExecution().executedPlan().toString().count("Window [") == 1
    assert sorted((r.scan_id, r.strict, r.path, r.raw) for r in lines.collect()) == [(1, True, "b/a.py", "+two"), (1, True, "b/a.py", "-one"), (2, False, "a.py", "+two"), (2, False, "a.py", "-one")]
