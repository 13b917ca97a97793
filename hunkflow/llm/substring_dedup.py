"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is the corpus itself, as far as it is new: a phrase of
``WINDOW`` words stands in the reference once, at its first place in the
document with the smallest id that has it, and its blocks are the runs of such
places. The index files each phrase under this place. A document is factored
greedily against the blocks: a factor begins at a word where a phrase of an
earlier document starts and goes on as long as document and reference move
along together, so it is one contiguous piece of one reference document, and
the longest there is, as no phrase stands in the reference twice. Phrases that
start before a factor's end and reach beyond it are looked up as well, so no
span hides behind a boundary. Factors become duplicate spans.

The index is built coarse to fine, so that most phrases never leave their task:

* Chunks: texts are cut where the hash of the next words says so, into pieces
  of some 24 words and the phrases that start in them. A chunk that an earlier
  document has as well is a factor at once, and its phrases need no entry: the
  earlier document has them.
* Anchors: of each phrase the least hash of its ``ANCHOR``-word parts. Equal
  phrases have equal anchors, neighbours mostly share theirs, and only phrases
  whose anchor occurs in two documents can be duplicates.
* Phrases: what is left enters the index.

Chunks and phrases are compared by two hashes of 64 bits, which both are made of
the 64-bit hashes of their words. So two different words of equal hash are taken
for one another: among n different words that happens to n * n / 2 ** 65 pairs,
about 3 for 10 ** 10 words, and a stretch is then wrongly equal only to one that
has all other words in common with it. Where ids repeat, rows are told apart by a hash
of the text as well, so an id may hold many rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hash_words, materialise, modest_batches, release, table

WINDOW = 13
ANCHOR = 5
CUT_WORDS, CUT_EVERY = 3, 24  # words that decide on a cut, one in so many places
SLICE = 256
NO_ID = (1 << 63) - 1  # a null id comes after all others
ROW = ["id", "sig"]


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mix(g: np.ndarray) -> np.ndarray:
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    return g


class Powers:
    """Powers of an odd base modulo 2 ** 64 and of its inverse, as many as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            more = lambda a, b: np.concatenate([a, a * np.uint64(pow(b, m, 1 << 64))])
            self.up, self.down = more(self.up, self.base), more(self.down, self.inverse)


#: Two independent hashes of word sequences.
BASES = (Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93))


class Sums:
    """Hashes of any stretch of a text's words from running sums."""

    def __init__(self, h: np.ndarray, base: Powers):
        base.reach(len(h) + 1)
        self.base, self.n = base, len(h)
        self.c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * base.up[: len(h)], dtype=np.uint64)])

    def rolled(self, width: int) -> np.ndarray:
        """Hash of the ``width`` words from each position on."""
        m = max(self.n - width + 1, 0)
        return _mix((self.c[width : width + m] - self.c[:m]) * self.base.down[:m])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the stretches [a, b)."""
        return _mix((self.c[b] - self.c[a]) * self.base.down[a] + (b - a).astype(np.uint64))


def sums(h: np.ndarray) -> tuple[Sums, Sums]:
    return Sums(h, BASES[0]), Sums(_mix(h * np.uint64(0xC2B2AE3D27D4EB4F)), BASES[1])


def anchors(first: Sums, window: int = WINDOW, width: int = ANCHOR) -> np.ndarray:
    """The anchor of each phrase: the least hash of the parts inside it."""
    least, have, want = first.rolled(width), 1, window - width + 1
    while have < want:
        by = min(have, want - have)
        least = np.minimum(least[:-by], least[by:])
        have += by
    return least


def chunks(both: tuple[Sums, Sums]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, two hashes) of the chunks: phrases that start in [start,
    end) lie within one, as do all words up to the end of the last of them."""
    cuts = np.flatnonzero(both[0].rolled(CUT_WORDS) % np.uint64(CUT_EVERY) == 0)
    a, b = cuts[:-1], cuts[1:]
    whole = b + WINDOW - 1 <= both[0].n
    a, b = a[whole], b[whole]
    return a, b, *(s.between(a, b + WINDOW - 1) for s in both)


_NONE = np.zeros(0, np.uint64)
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("ref_id", pa.int64()), ("ref_start", pa.int64())])
KEYS = "id long, sig long, k1 array<long>, k2 array<long>, pos array<int>"


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else _NONE
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))


def _firsts(k1: np.ndarray, k2: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, with its first place in the text."""
    _, at = np.unique(k1, return_index=True)
    return k1[at], k2[at], pos[at].astype(np.int32)


def _index_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors and chunks of the texts of at least one phrase."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            keep, found = [], []
            for i, t in enumerate(part.column(2)):
                words = split(t.as_py())
                if len(words) >= WINDOW:
                    both = sums(hash_words(words))
                    a, _, k1, k2 = chunks(both)
                    keep.append(i)
                    found.append((np.unique(anchors(both[0])), *_firsts(k1, k2, a)))
            if keep:
                some = part.take(pa.array(keep))
                lists = [_lists(list(c), k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *lists], [*ROW, "anchors", "k1", "k2", "pos"])


class Hits:
    """What a document's row says about its keys: (k1, k2, r, p) structs."""

    def __init__(self, column: pa.Array, i: int):
        v = column[i].values
        k1, k2, self.r, self.p = (np.zeros(0, np.int64) if v is None else v.field(n).to_numpy(zero_copy_only=False) for n in range(4))
        order = np.argsort(k1.view(np.uint64))
        self.k1, self.k2, self.r, self.p = k1.view(np.uint64)[order], k2.view(np.uint64)[order], self.r[order], self.p[order]

    def find(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are hits, and the entries of all keys (any, if it isn't one)."""
        if not len(self.k1):
            return np.zeros(len(k1), bool), np.zeros(len(k1), np.int64)
        at = np.minimum(np.searchsorted(self.k1, k1), len(self.k1) - 1)
        return (self.k1[at] == k1) & (self.k2[at] == k2), at


def _in_chunks(both: tuple[Sums, Sums], known: Hits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether, reference id, reference place) of each phrase's start in a known chunk."""
    inside, r, p = (np.zeros(both[0].n - WINDOW + 1, kind) for kind in (bool, np.int64, np.int64))
    if len(known.k1):
        a, b, k1, k2 = chunks(both)
        hit, at = known.find(k1, k2)
        for s, e, n in zip(a[hit].tolist(), b[hit].tolist(), at[hit].tolist(), strict=True):
            inside[s:e], r[s:e], p[s:e] = True, known.r[n], known.p[n] + np.arange(e - s)
    return inside, r, p


def _phrase_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases outside the known chunks whose anchors other documents have."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            keep, found = [], []
            for i, t in enumerate(part.column(2)):
                both = sums(hash_words(split(t.as_py())))
                known = np.sort(part.column(3)[i].values.to_numpy().view(np.uint64))
                own = anchors(both[0])
                open_ = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
                open_ &= ~_in_chunks(both, Hits(part.column(4), i))[0]
                pos = np.flatnonzero(open_)
                if len(pos):
                    keep.append(i)
                    found.append(_firsts(*(s.rolled(WINDOW)[pos] for s in both), pos))
            if keep:
                some = part.take(pa.array(keep))
                lists = [_lists(list(c), k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *lists], [*ROW, "k1", "k2", "pos"])


def factors(hit: np.ndarray, r: np.ndarray, p: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Greedy parse: (start, end, reference id, reference start) of the factors,
    given whether the phrase from each word on stands in the reference and
    where. A factor that starts before the previous one ends is a phrase that
    crosses the boundary."""
    if not hit.any():
        return []
    n = np.arange(len(r))
    begins = hit & np.concatenate([[True], ~hit[:-1] | (r[1:] != r[:-1]) | (p[1:] - p[:-1] != 1)])
    ends = hit & np.concatenate([~hit[1:] | begins[1:], [True]])
    return [(int(a), int(b) + window, int(r[a]), int(p[a])) for a, b in zip(n[begins], n[ends], strict=True)]


def _cut_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            n_words, n_removed, digests, spans = [], [], [], []
            for i, t in enumerate(part.column(2)):
                words, found = split(t.as_py()), []
                phrases, known = Hits(part.column(3), i), Hits(part.column(4), i)
                if (len(phrases.k1) or len(known.k1)) and len(words) >= WINDOW:
                    both = sums(hash_words(words))
                    inside, r, p = _in_chunks(both, known)
                    if len(phrases.k1):
                        hit, n = phrases.find(*(s.rolled(WINDOW) for s in both))
                        hit &= ~inside
                        r[hit], p[hit] = phrases.r[n[hit]], phrases.p[n[hit]]
                        inside |= hit
                    found = factors(inside, r, p)
                kept, end = [], 0
                for a, b, _, _ in found:
                    kept += words[end:a]
                    end = max(end, b)
                kept += words[end:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                spans.append([dict(zip(("start", "end", "ref_id", "ref_start"), f, strict=True)) for f in found])
            columns = [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests), pa.array(spans, pa.list_(_SPAN))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])


def _texts(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, sig, text). The hash tells rows of one id apart; where no id is
    repeated it would only add to what is moved, and is 0."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), "text")
    unique = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    sig: Column = F.lit(0).cast("long") if unique else F.xxhash64("text")
    return rows.select("id", sig.alias("sig"), "text")


# In both functions counts and minima are formed map-side, and what meets them
# is an equi-join whose large partitions may be split: a key in very many
# documents is harmless. The counts are written first, so that the files of
# only one of the two shuffles exist at a time.


def _shared_anchors(rows: DataFrame) -> DataFrame:
    """(id, sig, anchors): each document's anchors that occur elsewhere, too."""
    pairs = rows.select(*ROW, F.explode("anchors").alias("key"))
    known = materialise(pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    release(rows.sparkSession)
    found = materialise(pairs.join(known, "key").groupBy(*ROW).agg(F.collect_set("key").alias("anchors")))
    discard(known)
    return found


def _earlier(rows: DataFrame, name: str) -> DataFrame:
    """(id, sig, hits) of the documents with keys that a document of a smaller
    id has: hits are (k1, k2, r, p), with the first such document and the place there."""
    pairs = rows.select(*ROW, F.inline(F.arrays_zip("k1", "k2", "pos")))
    known = pairs.groupBy("k1", "k2").agg(F.min("id").alias("r"), F.min_by("pos", "id").alias("p"), F.max("id").alias("last")).where("r < last").drop("last")
    known = materialise(known)
    release(rows.sparkSession)
    met = pairs.join(known, ["k1", "k2"]).where("id > r").select(*ROW, F.struct("k1", "k2", "r", "p").alias("hit"))
    found = materialise(met.groupBy(*ROW).agg(F.collect_set("hit").alias(name)))
    discard(known)
    return found


def find_spans(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed``,
    ``kept_sha256`` and ``spans`` (start and end word of each factor, the
    reference document and where the factor starts in it; among rows that share
    the reference's id, in one of them).

    Words that are equal byte for byte, between ASCII white space, are equal.
    A text of fewer than 13 words, an empty or null one keeps all its words.
    A null id counts as larger than any other; rows that share an id are not
    earlier than each other. Within a document repetition is no duplicate. An
    empty table gives no rows; other columns are ignored.
    """
    modest_batches(docs)
    texts = _texts(docs, id_col)
    keyed = materialise(texts.mapInArrow(_index_rows, "id long, sig long, anchors array<long>, k1 array<long>, k2 array<long>, pos array<int>"))
    in_chunks = _earlier(keyed, "chunks")
    shared = _shared_anchors(keyed)
    discard(keyed)
    marks = shared.join(in_chunks, ROW, "left")
    phrases = materialise(texts.join(marks, ROW).select(*ROW, "text", "anchors", "chunks").mapInArrow(_phrase_rows, KEYS))
    discard(shared)
    hits = _earlier(phrases, "hits")
    discard(phrases)
    cut = texts.join(hits.join(in_chunks, ROW, "full"), ROW, "left").select(*ROW, "text", "hits", "chunks")
    cut = cut.mapInArrow(_cut_rows, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: long, end: long, ref_id: long, ref_start: long>>")
    return cut.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op5_substring_dedup(spark, sf_dir):
    return find_spans(table(spark, sf_dir, "documents")).drop("spans")


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(doc_id, {NO_ID}) AS id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT rid, id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) >= {WINDOW}),
g AS (SELECT rid, id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS phrase FROM w),
h AS (SELECT rid, i FROM g QUALIFY id > min(id) OVER (PARTITION BY phrase)),
c AS (SELECT DISTINCT rid, i + k AS i FROM h, range(0, {WINDOW}) r(k)),
x AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
k AS (SELECT x.rid, count(*) FILTER (c.i IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.i) FILTER (c.i IS NULL), '') AS kept
      FROM x LEFT JOIN c ON c.rid = x.rid AND c.i = x.i GROUP BY x.rid)
SELECT CASE WHEN id <> {NO_ID} THEN id END AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
