"""Repair of the structure of conversations at least cost, with an audit.

A conversation should read: perhaps a system turn, then pairs of a user and an
assistant turn. Turns are kept, given another role or deleted and turns are
inserted, each at a cost. The grammar has four states, so a set of them is four
bits. For each cost in turn, a layer holds one such set per turn: the states
from which the rest of the conversation can be accepted at exactly that cost,
found from the layers of lower cost by table look-ups. The first layer whose set
at the first turn holds the start gives the least cost, and following the bits
from there, always by the edit of the smallest letter, gives the least audit.

Conversations may be of any length. Turns are dealt by ranges of conversation
and turn, and cut into segments of bounded size. Most conversations are one
segment. Of the others, each segment first works out by itself what every pair
of states at its ends costs; these small matrices are folded from the end of the
conversation; then each segment is repaired knowing what its rest will cost. A
digest of the whole repaired text has to read its segments in order, one at a
time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import free_name, materialise, modest_batches, scratch, table

SEGMENT = 128  # turns of a segment at most: the work on one grows with its square
SEGMENT_CHARS = 1 << 18  # and characters, or one turn
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPT = 1 << START | 1 << ASSISTANT
NEXT = (USER, USER, ASSISTANT, USER)  # by state, where a user or assistant turn leads
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: By initial, where a turn that is kept leads from each state; nowhere: None.
KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
PAIRS = {"su", "ua", "au"}
# codes of a turn: its initial's number and what is wrong with it
INITIALS = "?sua"
TRUNCATED, BLANK, DUPLICATE = 4, 8, 16
FAR = 1 << 40  # a cost that nothing reaches

SEGMENTS = "conv_id long, part long, seg long, whole boolean, turns array<long>, roles array<string>, texts array<string>, codes array<long>, keys array<binary>"
AFTER = "conv_id long, part long, seg long, after array<long>"
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _sources(move: tuple[int | None, ...]) -> tuple[int, ...]:
    """For each set of states after a move, the set of states before it."""
    return tuple(sum(1 << q for q, to in enumerate(move) if to is not None and after >> to & 1) for after in range(16))


BEFORE_NEXT = _sources(NEXT)
BEFORE_KEPT = [_sources(KEPT.get(i, (None,) * 4)) for i in INITIALS]


def code_of(role: str, text: str, seen: bool) -> int:
    """A turn's initial, and the first of its faults."""
    code = max(INITIALS.find(role[:1] or "?"), 0)
    last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
    return code | (BLANK if not last else DUPLICATE if seen else TRUNCATED if last not in ".!?" else 0)


class Layers:
    """``sets[c][i]``: the states before turn ``i`` from which all that follows
    costs exactly ``c``. ``after`` says what follows the last turn: a cost and
    the states it is the cost of. ``ends``: turns may be inserted at the end."""

    def __init__(self, codes: list[int], after: list[tuple[int, int]], ends: bool):
        self.codes, self.n, self.after, self.ends = codes, len(codes), after, ends
        self.sets: list[bytearray] = []

    def add(self) -> int:
        """One more layer; its set before the first turn."""
        c, n, sets = len(self.sets), self.n, self.sets
        new = bytearray(n + 1)
        for cost, states in self.after:
            if cost == c:
                new[n] |= states
        three, four, six = (sets[c - d] if c >= d else None for d in (INSERT, DELETE, REROLE + BROKEN))
        if self.ends and three:
            new[n] |= BEFORE_NEXT[three[n]]
        for i in range(n - 1, -1, -1):
            code, got = self.codes[i], 0
            if four:
                got = four[i + 1]
            if three:
                got |= BEFORE_NEXT[three[i]]
            if not code & (BLANK | DUPLICATE):
                kept = BEFORE_KEPT[code & 3]
                if code & TRUNCATED:
                    if three:
                        got |= kept[three[i + 1]]
                    if six:
                        got |= BEFORE_NEXT[six[i + 1]]
                else:
                    got |= kept[new[i + 1]]
                    if three:
                        got |= BEFORE_NEXT[three[i + 1]]
            new[i] = got
        sets.append(new)
        return new[0]

    def has(self, c: int, i: int, state: int | None) -> bool:
        return c >= 0 and state is not None and bool(self.sets[c][i] >> state & 1)

    def trace(self, state: int) -> tuple[int, list[tuple[str, int, int]], int]:
        """The cost from ``state``, the least edits as (letter, turn, state it
        leads to), and the state at the end."""
        while not (self.sets and self.sets[-1][0] >> state & 1):
            self.add()
        left = cost = len(self.sets) - 1
        i, edits = 0, []
        while True:
            if i == self.n and any(c == left and s >> state & 1 for c, s in self.after):
                return cost, edits, state
            code = self.codes[i] if i < self.n else BLANK
            more = BROKEN if code & TRUNCATED else 0
            kept = KEPT.get(INITIALS[code & 3], (None,) * 4)[state]
            if i < self.n and self.has(left - DELETE, i + 1, state):
                edits.append(("D", i, state))
                left, i = left - DELETE, i + 1
            elif (i < self.n or self.ends) and self.has(left - INSERT, i, NEXT[state]):
                state = NEXT[state]
                edits.append(("I", i, state))
                left -= INSERT
            elif not code & (BLANK | DUPLICATE) and self.has(left - KEEP - more, i + 1, kept):
                state = kept
                edits.append(("K", i, state))
                left, i = left - KEEP - more, i + 1
            else:
                state = NEXT[state]
                edits.append(("R", i, state))
                left, i = left - REROLE - more, i + 1


def matrix(codes: list[int], ends: bool = False) -> list[int]:
    """Costs from each state before a segment to each state after it, row by row."""
    out = [FAR] * 16
    for to in range(4):
        layers = Layers(codes, [(0, 1 << to)], ends)
        missing = 15
        for c in range(DELETE * len(codes) + 4 * INSERT + 1):  # deleting all and inserting up to a pair costs no more
            new = layers.add() & missing
            missing &= ~new
            for state in range(4):
                if new >> state & 1:
                    out[4 * state + to] = c
            if not missing:
                break
    return out


class Repair:
    """One conversation, segment by segment in order."""

    def __init__(self):
        self.rows, self.gaps_seen, self.first, self.last = 0, 0, None, None
        self.counts, self.illegal, self.initial = [0, 0, 0], 0, None
        self.state, self.cost, self.audit, self.digest, self.lines = START, 0, [], hashlib.sha256(), 0

    def add(self, turns: list[int | None], roles: list[str], texts: list[str], codes: list[int], after: list[tuple[int, int]], ends: bool) -> None:
        for turn, role, code in zip(turns, roles, codes, strict=True):
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.last, self.gaps_seen = turn, self.gaps_seen + 1
            if self.rows and self.initial + role[:1] not in PAIRS:
                self.illegal += 1
            self.initial, self.rows = role[:1], self.rows + 1
            for k, fault in enumerate((BLANK, DUPLICATE, TRUNCATED)):
                self.counts[k] += bool(code & fault)
        base = min((c for c, _ in after), default=0)  # what follows costs that much from the best state
        layers = Layers(codes, [(c - base, s) for c, s in after], ends)
        cost, edits, self.state = layers.trace(self.state)
        self.cost += cost - next(c - base for c, s in after if s >> self.state & 1)
        self.audit.append("".join(e for e, _, _ in edits))
        for letter, i, state in edits:
            if letter != "D":
                role = roles[i] if letter == "K" else ROLE[state]
                line = f"{role}:{'' if letter == 'I' else texts[i]}"
                self.digest.update((("\n" if self.lines else "") + line).encode("utf-8", "replace"))
                self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.gaps_seen
        return gaps, *self.counts, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def _key(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "replace"), digest_size=16).digest()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _segments(most: int) -> Callable:
    """Segments of one sorted range. All but the first and last conversation of
    a range lie in it entirely, so one that is one segment is ``whole``; the
    others name what they hold (``keys``) for other ranges to compare."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)

    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, now, seen, first, part = [], [], None, set(), True, 0
        size = seg = 0

        def close(final: bool, last: bool) -> None:
            nonlocal held, size, seg
            whole = final and seg == 0 and not first and not last
            codes = [c for *_, c, _ in held]
            keys = None if whole else [k for *_, k in held]
            out.append((now[0], part, seg, whole, [t for t, *_ in held], [r for _, r, *_ in held], [x for _, _, x, *_ in held], codes, keys))
            held, size, seg = [], 0, seg + 1

        for part_, conv_id, present, turn, role, text in rows(batches):
            part = part_
            if now is None or now[0] != conv_id:
                if now is not None:
                    close(True, False)
                    first = False
                now, seen, seg = (conv_id,), set(), 0
            if present:
                if len(held) >= most or size >= SEGMENT_CHARS:
                    close(False, False)
                key = _key(role, text)
                held.append((turn, role, text, code_of(role, text, key in seen), key))
                seen.add(key)
                size += len(text)
            if len(out) >= 64:
                yield _batch(out, SEGMENTS)
                out = []
        if now is not None:
            close(True, True)
        if out:
            yield _batch(out, SEGMENTS)

    return go


def _solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations."""
    for batch in batches:
        rows = []
        for conv_id, turns, roles, texts, codes in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            c = Repair()
            c.add(turns, roles, texts, codes, [(0, ACCEPT)], True)
            rows.append((conv_id, *c.row()))
        yield _batch(rows, REPAIRED)


def _matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [batch.column(i) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*ids, pa.array([matrix(c.as_py()) for c in batch.column(3)], pa.list_(pa.int64()))], names=["conv_id", "part", "seg", "matrix"])


def _in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations whose segments come one after the other."""
    now, c, out = None, Repair(), []
    for batch in batches:
        for conv_id, turns, roles, texts, codes, after in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if now is None or now[0] != conv_id:
                if now is not None:
                    out.append((*now, *c.row()))
                now, c = (conv_id,), Repair()
            c.add(turns, roles, texts, codes, [(cost, 1 << s) for s, cost in enumerate(after) if cost < FAR] if after else [(0, ACCEPT)], not after)
        if out:
            yield _batch(out, REPAIRED)
            out = []
    if now is not None:
        yield _batch([(*now, *c.row())], REPAIRED)


def _joined_segments(rest: DataFrame) -> DataFrame:
    """Segments with the duplicates of earlier ranges marked in ``codes``."""
    by = ["conv_id", "part", "seg"]
    # within a range duplicates are known: one row per key and range is left, so no key has more rows than there are ranges
    keys = rest.select(*by, F.posexplode(F.arrays_zip("keys", "codes")).alias("pos", "k")).where(F.col("k.codes") < BLANK)
    firsts = W.partitionBy("conv_id", "k.keys").orderBy("part", "seg", "pos")
    late = keys.withColumn("n", F.row_number().over(firsts)).where("n > 1").groupBy(*by).agg(F.collect_set("pos").alias("late"))
    marked = F.transform("codes", lambda c, i: F.when(F.array_contains("late", i), c.bitwiseAND(F.lit(3)) + DUPLICATE).otherwise(c))
    return _beside(rest, late, "late").withColumn("codes", F.when(F.col("late").isNull(), F.col("codes")).otherwise(marked)).drop("late", "keys")


def _beside(segments: DataFrame, more: DataFrame, column: str) -> DataFrame:
    same = F.col("r.conv_id").eqNullSafe(F.col("m.conv_id")) & (F.col("r.part") == F.col("m.part")) & (F.col("r.seg") == F.col("m.seg"))
    return segments.alias("r").join(more.alias("m"), same, "left").select("r.*", column)


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What follows each segment but the last costs from each state; segments
    come from the end of their conversation."""
    now, follows = None, []
    for batch in batches:
        out = []
        for conv_id, part, seg, m in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if now is None or now[0] != conv_id:
                now, follows = (conv_id,), [0, 2 * INSERT, INSERT, 0]  # at the end turns can only be inserted
            else:
                out.append((conv_id, part, seg, follows))
            follows = [min(m[4 * q + to] + follows[to] for to in range(4)) for q in range(4)]
        yield _batch(out, AFTER)


def _costs(segments: DataFrame) -> DataFrame:
    m = modest_batches(segments.select("conv_id", "part", "seg", "codes")).mapInArrow(_matrices, "conv_id long, part long, seg long, matrix array<long>")
    return m.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seg")).mapInArrow(_fold, AFTER)


def repair(rows: DataFrame, present: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """One row per conversation of ``rows`` (``conv_id``, ``turn``, ``role``,
    ``text``): ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``,
    ``cost``, ``audit``, ``repaired_sha256``.

    Turns are read in the order of ``turn``, nulls first, then of role and
    text. Nulls of role and text count as one space; a null ``conv_id`` is a
    conversation of its own. Of repeated rows all but the first are duplicates.
    Rows for which the column ``present`` is false are no turns: they only say
    that there is such a conversation, and one without any turn gets zeros, an
    empty audit and the digest of nothing. Texts of any length are read whole;
    an empty table gives no rows; other columns are ignored.
    """
    held = F.lit(True) if present is None else F.coalesce(F.col(present).cast("boolean"), F.lit(False))
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), held.alias("present"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    with scratch(rows.sparkSession) as keep:
        order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
        ranged = turns.withColumn("start", F.substring("text", 1, 64)).repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", "start").sortWithinPartitions(*order)
        ranged = ranged.select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "present", "turn", "role", "text")
        segments = materialise(modest_batches(ranged).mapInArrow(_segments(segment), SEGMENTS))
        whole = segments.where("whole").select("conv_id", "turns", "roles", "texts", "codes").mapInArrow(_solve, REPAIRED)
        rest = materialise(_joined_segments(segments.where("NOT whole")))
        after = _beside(rest, _costs(rest), "after")
        order = ["turns", "roles", "texts", "codes", "after"]
        joined = after.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg").select("conv_id", *order).mapInArrow(_in_order, REPAIRED)
        return keep(materialise(whole.unionByName(joined)))


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` with faults put in by a checksum of ``conv_id:turn``: of twenty
    values 0 drops the row (it stays with ``present`` false), 1 empties its
    text, 2 takes out sentence ends, 3 repeats it, 4 makes it a user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = free_name(rows, "how")
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20).alias(how))
    what = F.col(how)
    text = F.when(what == 1, "").when(what == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(what == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(what == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (what != 0).alias("present"), copies.alias("copy"))


def op12_conversation_repair(spark, sf_dir):
    return repair(damage(table(spark, sf_dir, "conversations")), "present")
