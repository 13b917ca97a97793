"""Resampling documents towards a target distribution by hashed n-grams.

Each feature of a text (a run of one or more words) falls into one of at most
65,536 buckets. A first pass writes the texts as packed streams of 16-bit bucket
numbers with the offsets of their documents, so that nothing reads or hashes a
text twice. Counting is an external sort: each block of a stream is sorted and
run-length encoded, and the runs of all blocks are summed in one shuffle. Two
such counts, of the raw documents and of the target, give each bucket a gain;
the gains are looked up for whole blocks and summed per document at its offsets.

Documents are drawn without replacement: the highest weights plus a Gumbel
number made from the id win, which are exact draws in proportion to exp(weight).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import materialise, modest_batches, scratch, table, worker_cache

BUCKETS = 10_000
RUN = 1  # words of the longest feature
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
BLOCK = 1 << 22  # features of a block; a longer document is one by itself
REMEMBERED, LONGEST = 120_000, 64  # features whose bucket a worker remembers, and their longest in bytes
STREAM = "doc_id array<long>, n_words array<long>, offset array<long>, stream binary"
#: A-Z as small letters, and a space for every ASCII character that is in no word.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class Buckets(dict):
    """Bucket numbers of features, a bounded number of them remembered."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        b = zlib.crc32(feature) % self.n
        if len(feature) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[feature] = b
        return b


def features(text: bytes | None, run: int) -> tuple[int, list[bytes]]:
    """The number of words, and all runs of up to ``run`` of them."""
    words = (text or b"").translate(_FOLD).split()
    out = list(words)
    for n in range(2, run + 1):
        out += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return len(words), out


def _streamer(run: int, buckets: int) -> Callable:
    def block(rows: list[tuple]) -> pa.RecordBatch:
        offsets = np.cumsum([0, *(len(s) for _, _, s in rows)])[:-1]
        columns = [[r[0] for r in rows]], [[r[1] for r in rows]], [offsets.tolist()]
        stream = np.concatenate([s for _, _, s in rows]).astype("<u2").tobytes()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.list_(pa.int64())) for c in columns), pa.array([stream], pa.binary())], names=[f.split()[0] for f in STREAM.split(", ")])

    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache(f"buckets {buckets}", lambda: Buckets(buckets))
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, found = features(text.as_py(), run)
                rows.append((doc_id, n, np.fromiter(map(known.__getitem__, found), np.uint16, len(found))))
                held += len(found)
                if held >= BLOCK:
                    yield block(rows)
                    rows, held = [], 0
            if rows:
                yield block(rows)

    return go


def bucket_streams(docs: DataFrame, run: int = RUN, buckets: int = BUCKETS, id_col: str | None = "doc_id") -> DataFrame:
    """Blocks of documents: their ids, numbers of words and offsets (in
    features) in ``stream``, which holds one little-endian uint16 per feature."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("16-bit streams hold at most 65536 buckets")
    doc_id = F.lit(None) if id_col is None else F.col(id_col)
    rows = docs.select(doc_id.cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return modest_batches(rows).mapInArrow(_streamer(run, buckets), STREAM)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for stream in batch.column(0):
            ids = np.sort(np.frombuffer(stream.as_py(), "<u2"))
            at = np.flatnonzero(np.diff(ids, prepend=-1) if len(ids) else ids)
            n = np.diff(at, append=len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at].astype(np.int64)), pa.array(n.astype(np.int64))], names=["bucket", "n"])


def bucket_counts(streams: DataFrame) -> DataFrame:
    """(bucket, n) of all blocks: sorted runs, summed."""
    return streams.select("stream").mapInArrow(_runs, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: 1000 times the logarithm of how much
    likelier it is in the target, both counts with one added per bucket."""
    both = raw.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = both.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    both = materialise(both)
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    real = lambda c: F.col(c).cast("double")
    ratio = ((real("t") + 1) * float(all_s + buckets)) / ((real("s") + 1) * float(all_t + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _weigher(table_: np.ndarray) -> Callable:
    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, offsets, streams = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                gained = table_[np.frombuffer(streams[i].as_py(), "<u2")]
                start = np.array(offsets[i].as_py(), np.int64)
                n = np.diff(start, append=len(gained))
                weight = np.zeros(len(start), np.int64)
                some = n > 0  # reduceat would give an empty document its successor's first feature
                if some.any():
                    weight[some] = np.add.reduceat(gained, start[some])
                yield pa.RecordBatch.from_arrays([ids[i].values, words[i].values, pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return go


def weights(streams: DataFrame, gain: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight) per document. ``gain`` has one row
    per bucket, so 65,536 at most: it travels with the tasks as one array."""
    rows = gain.collect()
    held = np.zeros(max((r.bucket for r in rows), default=0) + 1, np.int64)
    held[[r.bucket for r in rows]] = [r.gain for r in rows]
    return streams.mapInArrow(_weigher(held), "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A thousand times a standard Gumbel number made from the id."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """Every document: ``doc_id``, ``n_features``, ``weight``, ``score`` and
    ``rank``: 1, 2, ... of the drawn ones, null of the others. ``target`` needs
    a column ``text`` only.

    A null or empty text has no features and weight 0, and with fewer than
    ``least_words`` words a document is never drawn. Texts of any length are
    read whole. Equal scores are ordered by id (a null id first, and hashed as
    an empty one); rows that repeat an id get the same random number and are
    drawn each by itself. An empty table gives no rows, an empty target counts
    as one without features; other columns are ignored.
    """
    with scratch(docs.sparkSession) as keep:
        streams = materialise(bucket_streams(docs, run, buckets, id_col))
        gain = gains(bucket_counts(streams), bucket_counts(bucket_streams(target, run, buckets, None)), buckets)
        scored = weights(streams, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
        scored = keep(materialise(scored))
    out = ["doc_id", "n_features", "weight", "score"]
    fit = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    n = scored.where(fit).count() * percent // 100
    if not n:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    order = scored.where(fit).select(*out, (-F.col("score")).alias("down"))
    place = numbered(order, ["down", "doc_id", "n_features", "weight"], "place", 1)
    drawn = place.select(*out, F.when(F.col("place") <= n, F.col("place")).alias("rank"))
    return drawn.unionByName(scored.where(~fit).select(*out, F.lit(None).cast("long").alias("rank")))


def op13_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH RECURSIVE k(i, v, step) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL
    SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, step + 1 FROM k WHERE step < 8),
crc AS (SELECT list(v ORDER BY i) AS l FROM k WHERE step = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT {_WORDS} AS ws FROM benchmark),
dw AS (SELECT rid, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b),
v AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
h AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
      lambda c, y: xor(l[1 + (xor(c, y) & 255)], c >> 8)), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM v, crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN h USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM bw JOIN h USING (w) GROUP BY bucket),
g AS (SELECT r.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + {BUCKETS})::DOUBLE) / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
      FROM range({BUCKETS}) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT rid, sum(gain)::BIGINT AS weight FROM dw JOIN h USING (w) JOIN g USING (bucket) GROUP BY rid),
c AS (SELECT rid, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
      coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (rid)),
o AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM c WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM o) * {PERCENT} // 100 THEN place END::BIGINT AS rank FROM c LEFT JOIN o USING (rid)
"""
