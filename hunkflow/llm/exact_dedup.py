"""Exact deduplication over a cuckoo-filter index of live digests.

The index is split by digest into parts. A part holds a cuckoo filter and,
per filter bucket, the full digests filed there ("bucketed content"): the
filter answers most lookups of new texts, a hit is confirmed against the
bucket's digests, and a filter that overflows is rebuilt at twice the size
from those stored keys. Digests can be taken out again when their last
document goes.

Copies are folded twice: first where they are read, each task through an index
of bounded size, then per part. So a text with many copies reaches its part as
one row per task. Nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, BROADCAST_ROWS, free_name, frugal, materialise, partitions, table, text_or_empty

SLOTS = 4  # fingerprints in a filter bucket
KICKS = 200  # moves before an insertion counts as overflow
LOCAL_KEYS = 100_000  # digests a reading task folds before it passes them on
PART_KEYS = 200_000  # rows that one part should receive
HOT = 10_000


class CuckooIndex:
    """Cuckoo filter with the keys it stands for. ``values`` maps a live key to
    its entry; ``probe`` uses the filter first and the keys only on a hit."""

    def __init__(self, buckets: int = 1024):
        self._resize(buckets)
        self.content: dict[int, dict[bytes, list]] = {}
        self.n = self.resizes = self.false_hits = 0

    def _resize(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table = bytearray(2 * SLOTS * buckets)
        self.view = memoryview(self.table).cast("H")

    @staticmethod
    def _print(key: bytes) -> int:
        return int.from_bytes(key[8:10], "little") or 1

    def _pair(self, key: bytes, f: int) -> tuple[int, int]:
        i = int.from_bytes(key[:8], "little") & self.mask
        return i, (i ^ (f * 0x5BD1E995)) & self.mask

    def _add_print(self, i: int, j: int, f: int) -> bool:
        view = self.view
        for b in (i, j):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if not view[s]:
                    view[s] = f
                    return True
        b = j
        for kick in range(KICKS):
            s = b * SLOTS + (kick * 7 + f) % SLOTS
            f, view[s] = view[s], f
            b = (b ^ (f * 0x5BD1E995)) & self.mask
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if not view[s]:
                    view[s] = f
                    return True
        return False

    def maybe(self, key: bytes) -> bool:
        f = self._print(key)
        i, j = self._pair(key, f)
        view = self.view
        return f in view[i * SLOTS : i * SLOTS + SLOTS].tolist() or f in view[j * SLOTS : j * SLOTS + SLOTS].tolist()

    def probe(self, key: bytes) -> list | None:
        """The entry of a live key, or None."""
        if not self.maybe(key):
            return None
        entry = self.content.get(int.from_bytes(key[:4], "little"), {}).get(key)
        self.false_hits += entry is None
        return entry

    def insert(self, key: bytes, entry: list) -> None:
        """Add a key that is not live yet."""
        self.content.setdefault(int.from_bytes(key[:4], "little"), {})[key] = entry
        self.n += 1
        f = self._print(key)
        if not self._add_print(*self._pair(key, f), f):
            self._rebuild()

    def _rebuild(self) -> None:
        """From the stored keys, at a size that takes all of them."""
        buckets = 2 * (self.mask + 1)
        while True:
            self._resize(buckets)
            self.resizes += 1
            if all(self._add_print(*self._pair(k, f := self._print(k)), f) for k in self.keys()):
                return
            buckets *= 2

    def delete(self, key: bytes) -> bool:
        """Take out a live key; False if it isn't one."""
        if self.probe(key) is None:
            return False
        at = int.from_bytes(key[:4], "little")
        del self.content[at][key]
        if not self.content[at]:
            del self.content[at]
        f = self._print(key)
        for b in self._pair(key, f):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.view[s] == f:
                    self.view[s] = 0
                    self.n -= 1
                    return True
        raise AssertionError("a live key has no fingerprint")

    def keys(self) -> Iterator[bytes]:
        return (k for part in self.content.values() for k in part)

    def items(self) -> Iterator[tuple[bytes, list]]:
        return (x for part in self.content.values() for x in part.items())


ENTRY = "sha binary, n_cp long, doc_id long, rid long, n long, tied long"


def _better(a: list, b: list) -> bool:
    """Whether entry a = [n_cp, doc_id, rid, n, tied] stays before b: more code
    points, then the smaller id (null last), then the earlier row."""
    key = lambda e: (-e[0], e[1] is None, e[1] or 0, e[2])
    return key(a) < key(b)


def _fold(index: CuckooIndex, key: bytes, new: list) -> None:
    old = index.probe(key)
    if old is None:
        index.insert(key, new)
        return
    n, tied = old[3] + new[3], old[4] + new[4] if old[:2] == new[:2] else (new if _better(new, old) else old)[4]
    if _better(new, old):
        old[:3] = new[:3]
    old[3:] = [n, tied]


def _rows(index: CuckooIndex) -> pa.RecordBatch:
    keys, entries = [], []
    for k, e in index.items():
        keys.append(k)
        entries.append(e)
    columns = [pa.array(keys, pa.binary()), *(pa.array([e[i] for e in entries], pa.int64()) for i in range(5))]
    return pa.RecordBatch.from_arrays(columns, ["sha", "n_cp", "doc_id", "rid", "n", "tied"])


def _folder(limit: int | None):
    """mapInArrow function: rows of ENTRY with equal digests become one. With a
    limit, what has gathered is passed on each time that many keys are live."""

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for sha, *entry in zip(*columns, strict=True):
                _fold(index, sha, entry)
            if limit and index.n >= limit:
                yield _rows(index)
                index = CuckooIndex()
        if index.n:
            yield _rows(index)

    return fold


def normalised():
    """The text without white space; null counts as empty."""
    return F.translate(text_or_empty(), ASCII_SPACE, "")


def digests(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.select(
        F.unhex(F.sha2(normalised().cast("binary"), 256)).alias("sha"),
        F.char_length(text_or_empty()).cast("long").alias("n_cp"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("rid"),
        F.lit(1).cast("long").alias("n"),
        F.lit(1).cast("long").alias("tied"),
    )


def fold_copies(rows: DataFrame, n_rows: int) -> DataFrame:
    """One row per digest: the document that stays (n_cp, doc_id, rid), the
    number of copies, and how many of them tie with it in length and id."""
    local = rows.mapInArrow(frugal(_folder(LOCAL_KEYS)), ENTRY)
    parts = partitions(rows.sparkSession, n_rows, PART_KEYS)
    return local.repartition(parts, "sha").mapInArrow(frugal(_folder(None)), ENTRY)


def apply_deletions(live: DataFrame, gone: DataFrame, parts: int) -> DataFrame:
    """Take documents out of an index. ``live`` and ``gone`` have ENTRY's
    columns, one row per digest; a digest leaves when no copy of it is left.
    A digest in ``gone`` that isn't live is ignored. Where the kept document
    itself goes, the caller chooses another from the copies that are left."""

    def remove(batches):
        index = CuckooIndex()
        late = []
        for batch in batches:
            for sha, *entry, dead in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                late.append((sha, entry)) if dead else _fold(index, sha, entry)
        for sha, entry in late:
            old = index.probe(sha)
            if old is not None:
                old[3] -= entry[3]
                if old[3] <= 0:
                    index.delete(sha)
        if index.n:
            yield _rows(index)

    both = live.withColumn("dead", F.lit(False)).unionByName(gone.withColumn("dead", F.lit(True)))
    return both.repartition(parts, "sha").mapInArrow(remove, ENTRY)


def dedup(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``.

    A null text is an empty one, so null, empty and blank texts are copies of
    each other. Rows that repeat both id and text count separately and one of
    them stays; a null id loses against any other. Other columns are ignored.
    """
    rows = materialise(digests(docs, id_col))
    n_rows = rows.count()
    groups = materialise(fold_copies(rows, n_rows).where("n > 1"))
    best = groups.select("sha", F.col("doc_id").alias("best"), F.col("rid").alias("best_rid"), "n")
    # there are fewer than HOT groups with more than one in HOT of all rows: these
    # are broadcast, and no other one is large enough to burden a partition
    hot = F.broadcast(best.where(F.col("n") * HOT > n_rows))
    rest = rows.drop("n").join(hot.select("sha"), "sha", "left_anti").join(best.where(F.col("n") * HOT <= n_rows), "sha", "left")
    joined = rows.drop("n").join(hot, "sha").unionByName(rest)
    single = F.col("n").isNull()
    return joined.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("best")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("rid") == F.col("best_rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that stay, with all their columns; ``dedup`` says which.
    Of rows that repeat id and text one stays; null, empty and blank texts are
    one group; an empty table gives no rows; columns of any name may be there."""
    rows = materialise(digests(docs, id_col))
    groups = materialise(fold_copies(rows, rows.count()).where("n > 1"))
    sha, cp, best, best_cp, tied = (free_name(docs, n) for n in ("_sha", "_cp", "_best", "_best_cp", "_tied"))
    best_rows = groups.select(F.col("sha").alias(sha), F.col("doc_id").alias(best), F.col("n_cp").alias(best_cp), F.col("tied").alias(tied))
    if groups.count() <= BROADCAST_ROWS:  # else texts meet their groups in a shuffle
        best_rows = F.broadcast(best_rows)
    joined = docs.withColumns({sha: F.unhex(F.sha2(normalised().cast("binary"), 256)), cp: F.char_length(text_or_empty()).cast("long")}).join(best_rows, sha, "left")
    stays = F.col(tied).isNull() | ((F.col(cp) == F.col(best_cp)) & F.col(id_col).cast("long").eqNullSafe(F.col(best)))
    kept = joined.where(stays)
    once = kept.where(F.coalesce(F.col(tied), F.lit(1)) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
    if groups.where("tied > 1").isEmpty():
        return once
    # rows that repeat id and length of the one that stays: any one of them
    again = kept.where(F.col(tied) > 1).dropDuplicates([sha]).select(*(F.col(f"`{c}`") for c in docs.columns))
    return once.unionAll(again)


def op3_exact_dedup(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents"))


def kept_sql(source: str) -> str:
    return f"""
d3 AS (SELECT *, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS cp FROM {source}),
g3 AS (SELECT *, row_number() OVER w AS rn, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
       FROM d3 WINDOW w AS (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id NULLS LAST))"""


OP3_SQL = f"WITH {kept_sql('documents')} SELECT doc_id, keep_id, group_size::BIGINT AS group_size, rn = 1 AS kept, text_sha256 FROM g3"
