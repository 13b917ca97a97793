"""Quality classifier: a generalised additive model with pairwise terms.

Each feature of a text is cut into bins, and the model is a sum of lookup
tables: one per feature and one for each of a few pairs of features. The
tables are learned by cyclic boosting: in turn, every table takes a small step
along a shallow tree fitted to the log-loss gradients in its bins; the pairs
follow once the single features have converged. Scoring adds up table cells.

Training sees at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of their
id, of which it gathers the features; everything else covers all documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import modest_batches, table
from .quality_rules import measure

TRAIN_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 250, 60, 0.1, 3
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "bangs", "stops", "commas", "digits", "distinct", "line_length", "non_ascii", "runs")
_DIGITS, _ASCII = b"0123456789", bytes(range(128))


def features(text: str | None) -> list[float]:
    """Numbers that describe a whole text; null counts as empty."""
    n, chars, symbols, dups, repeats, lines, capitals = measure(text)
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    w, c = max(n, 1), max(chars, 1)
    runs = sum(map(bytes.__eq__, words[1:], words[:-1]))
    count = lambda chars_: len(b) - len(b.translate(None, chars_))
    return [float(np.log1p(n)), chars / w, symbols / c, dups / max(lines, 1), repeats / w, capitals / c, b.count(b"!") / w, b.count(b".") / w, b.count(b",") / w, count(_DIGITS) / c, len(set(words)) / w, n / max(lines, 1), len(b.translate(None, _ASCII)) / max(len(b), 1), runs / w]


@dataclass
class Model:
    edges: list[np.ndarray]  # inner bin edges per feature
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, f], "right")]
        coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.pair_edges)]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="higher")) if len(x) else np.zeros(0)


def _step(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """A tree over ordered bins: cut where it helps most, then step along each leaf."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                m = np.arange(a + 1, b)
                d = gain(a, m) + gain(m, b) - gain(a, b)
                k = int(d.argmax())
                best = max(best, (float(d[k]), int(m[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _step2(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree over two features: one cut of each, and the gain of the four leaves."""
    cg, ch = (np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (g, h))
    part = lambda c: np.stack([c[1:-1, 1:-1], c[1:-1, -1:] - c[1:-1, 1:-1], c[-1:, 1:-1] - c[1:-1, 1:-1], c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + c[1:-1, 1:-1]])
    pg, ph = part(cg), part(ch)
    if not pg.size:
        return np.zeros_like(g), 0.0
    gains = (pg**2 / (ph + 1.0)).sum(0)
    r, c = np.unravel_index(int(gains.argmax()), gains.shape)
    v = pg[:, r, c] / (ph[:, r, c] + 1.0)
    out = np.empty_like(g)
    out[: r + 1, : c + 1], out[: r + 1, c + 1 :], out[r + 1 :, : c + 1], out[r + 1 :, c + 1 :] = v
    return out, float(gains[r, c] - cg[-1, -1] ** 2 / (ch[-1, -1] + 1.0))


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Deterministic. Without rows every score is 1/2; with labels of one kind
    only, the smoothed share of that label."""
    n, width = len(y), len(FEATURES)
    x = x.reshape(n, width)
    rate = (y.sum() + 1) / (n + 2)
    base = float(np.log(rate / (1 - rate)))
    edges, coarse = [_edges(x[:, f], BINS) for f in range(width)], [_edges(x[:, f], PAIR_BINS) for f in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    z = np.full(n, base)
    for _ in range(ROUNDS if 0 < y.sum() < n else 0):
        for f in range(width):
            p = 1 / (1 + np.exp(-z))
            g, h = (np.bincount(bins[f], v, len(tables[f])) for v in (y - p, p * (1 - p)))
            step = RATE * _step(g, h, LEAVES)
            tables[f] += step
            z += step[bins[f]]
    cb = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        at = cb[i] * shape[1] + cb[j]
        p = 1 / (1 + np.exp(-z))
        return at, *(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))

    ranked = sorted(combinations(range(width), 2), key=lambda ij: -_step2(*cells(*ij)[1:])[1]) if n else []
    pairs = ranked[:PAIRS]
    pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in pairs]
    for _ in range(PAIR_ROUNDS if 0 < y.sum() < n else 0):
        for k, (i, j) in enumerate(pairs):
            at, g, h = cells(i, j)
            step = RATE * _step2(g, h)[0]
            pair_tables[k] += step
            z += step.ravel()[at]
    return Model(edges, tables, coarse, pairs, pair_tables, base)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _featured(docs: DataFrame) -> DataFrame:
    """(_id, _y, text) becomes (_id, y, x)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["_id", "y", "x"])

    modest_batches(docs)
    return docs.select("_id", F.col("_y").cast("int").alias("y"), "text").mapInArrow(run, "_id long, y int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """Train on at most ``rows`` labelled documents that aren't held out, chosen
    by a hash of their id. Of several labels for one document the highest
    counts, of several texts of one id the one with the least features; null
    labels and ids are left out. Without labels every score is 1/2."""
    known = labels.where(~held_out(id_col)).where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label).alias("_y"))
    chosen = known.orderBy(F.xxhash64("_id", F.lit(4)), "_id").limit(rows)
    # one row per chosen id: the sample may be broadcast and its features gathered
    some = docs.select(F.col(id_col).cast("long").alias("_id"), "text").join(F.broadcast(chosen), "_id")
    got = _featured(some).groupBy("_id").agg(F.min("x").alias("x"), F.max("y").alias("y")).collect()
    got.sort(key=lambda r: (list(r.x), r.y))
    return train(np.array([r.x for r in got], float), np.array([r.y for r in got], float))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``.
    Empty and null texts are scored as texts without words; repeated rows get
    equal scores; other columns are ignored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                score = model.score(np.array([features(t.as_py()) for t in part.column(2)]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score)], ["doc_id", "held_out", "score"])

    modest_batches(docs)
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_quality_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
