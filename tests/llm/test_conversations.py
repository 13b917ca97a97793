"""Repair of conversations against a plain search over all edits."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from hunkflow.llm import conversations as C
from tests.conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = {"": "su", "s": "u", "u": "a", "a": "u"}  # by the last initial, the next ones


def _search(rows):
    """Least (cost, audit, repaired lines) by relaxing until nothing changes."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {(len(rows), q): (0, "", ()) for q in ("", "a")}
    changed = True
    while changed:
        changed = False
        for i in range(len(rows), -1, -1):
            for q in GRAMMAR:
                options = [best[i, q]] if (i, q) in best else []

                def edit(letter, cost, to, j, line):
                    if (j, to) in best:  # noqa: B023
                        c, audit, lines = best[j, to]
                        options.append((c + cost, letter + audit, (line, *lines) if line is not None else lines))  # noqa: B023

                turn = "a" if q == "u" else "u"
                name = {"u": "user", "a": "assistant"}[turn]
                edit("I", 3, turn, i, f"{name}:")
                if i < len(rows):
                    role, text = rows[i]
                    more = 3 * (faults[i] == "truncated")
                    edit("D", 4, q, i + 1, None)
                    if faults[i] not in ("blank", "duplicate"):
                        edit("R", 3 + more, turn, i + 1, f"{name}:{text}")
                        if role[:1] and role[:1] in GRAMMAR[q]:
                            edit("K", more, role[0], i + 1, f"{role}:{text}")
                if options and min(options) != best.get((i, q)):
                    best[i, q] = min(options)
                    changed = True
    cost, audit, lines = best[0, ""]
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), collections.Counter(faults)


def _brute(rows):
    """What the operator returns, for (conv_id, turn, role, text) rows."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = set()
    for conv, turns in by.items():
        turns.sort()
        cost, audit, digest, faults = _search([t[2:] for t in turns])
        numbers = {t for has, t, *_ in turns if has}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        out.add((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest))
    return out


def _random_rows(seed, conversations, most):
    rng = random.Random(seed)
    roles, texts = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "s", "uncle"], ["Fine.", "So?", "cut", "", " \n", None, "Fine. ", "é!", "x.\t"]
    return [(None if c == 0 else c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}.") for c in range(conversations) for _ in range(rng.randrange(1, most))]


@pytest.mark.parametrize("segment,partitions", [(128, 4), (1, 7), (3, 1)])
def test_repair_equals_search(spark, segment, partitions):
    rows = _random_rows(segment, 60, 14)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame(rows, SCHEMA).withColumns({"part": F.lit("x"), "codes": F.lit(1), "cost": F.lit(2)})
        got = [tuple(r) for r in C.repair(df, segment=segment).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(set(got)) == 60 and set(got) == _brute(rows)


def test_one_conversation_over_many_ranges(spark):
    rng = random.Random(2)
    rows = [(7, i // 2 if i % 5 else None, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "b", "", f"{i}."])) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert {tuple(r) for r in C.repair(df, segment=16).collect()} == _brute(rows)


def test_one_row_many_times(spark):
    df = spark.range(5000).selectExpr("1L AS conv_id", "2L AS turn", "'user' AS role", "'Hi.' AS text")
    row = C.repair(df).first()
    # the first is kept and answered, all others go
    assert (row.duplicate, row.cost, row.gaps, row.illegal) == (4999, 4 * 4999 + 3, 0, 4999) and sorted(row.audit) == ["D"] * 4999 + ["I", "K"]


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.repair(none).count() == 0 and C.repair(C.damage(none), "present").count() == 0
    gone = spark.createDataFrame([(None, None, None, None, False), (4, 1, "user", "a", None)], SCHEMA + ", here boolean")
    empty = hashlib.sha256(b"").hexdigest()
    assert {tuple(r) for r in C.repair(gone, "here").collect()} == {(c, 0, 0, 0, 0, 0, 0, "", empty) for c in (None, 4)}
    long = spark.createDataFrame([(1, 0, "user", "x y. " * 400_000), (1, 1, "assistant", "z" * 1_000_000 + ".")], SCHEMA)
    assert C.repair(long).first().audit == "KK"


def test_layers_of_a_whole_conversation():
    codes = [C.code_of(r, t, False) for r, t in [("system", "S."), ("user", "Hi."), ("assistant", "Yes."), ("assistant", "cut")]]
    assert codes == [1, 2, 3, 3 | C.TRUNCATED]
    cost, edits, state = C.Layers(codes, [(0, C.ACCEPT)], True).trace(C.START)
    assert (cost, "".join(e for e, _, _ in edits), state) == (4, "KKKD", C.ASSISTANT)
    m = C.matrix(codes)
    assert m[4 * C.START + C.ASSISTANT] == 4 and m[4 * C.USER + C.START] == C.FAR


def test_query_equals_search(spark):
    rows = []
    original = spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    for r in original:
        how = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", r.text) if how == 2 else r.text
        rows += [(r.conv_id, r.turn, "user" if how == 4 else r.role, text)] * {0: 0, 3: 2}.get(how, 1)
    want, empty = _brute(rows), hashlib.sha256(b"").hexdigest()
    want |= {(c, 0, 0, 0, 0, 0, 0, "", empty) for c in {r.conv_id for r in original} - {r[0] for r in rows}}
    assert {tuple(r) for r in C.op12_conversation_repair(spark, SMALL).collect()} == want
