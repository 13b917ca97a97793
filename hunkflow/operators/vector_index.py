"""A nearest-neighbour index: inverted lists of 8-bit codes.

A coarse quantiser (spherical k-means) is fitted on a bounded sample and deals
every vector to the cell of its nearest centre. The cells are a table
partitioned by cell, with a code of one byte per dimension beside each id, and
the vectors themselves in a second table. A search reads the lists of the few
cells nearest to each query, scores their codes, and ranks the best of them again
by their exact vectors. How many lists that takes depends on how clustered the
vectors are, so it is measured when the index is built: for a bounded number of
rows the exact neighbours are sought, and enough lists are read to hold most.

Queries and rows of one cell meet in blocks of bounded size: rows are cut into
pieces and queries into blocks by hashes of their ids, as many as their numbers
ask for, so a cell that holds a third of all rows is shared by many tasks. Each
block keeps a few rows per query, and nothing else is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import vectors

SAMPLE_ROWS = 20_000  # vectors that the quantiser is fitted on
MOST_CELLS = 4096
ROUNDS = 12  # of k-means
CLIPPED = 0.99  # quantile of the absolute values that the codes span
LIST_ROWS, QUERY_ROWS, AT_ONCE = 50_000, 2_000, 128  # of a block, and queries scored together
TRIED = 100  # rows, of the sample, whose neighbours are sought exactly to choose the number of lists to read
TARGET = 0.96  # share of those neighbours that must lie in the lists
FINDS = 10  # times k candidates are ranked again


@dataclass
class Quantiser:
    """Centres of the cells, one per row, and the value of one step of a code."""

    centres: np.ndarray
    step: float

    def cells(self, v: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each row, nearest first."""
        near = v @ self.centres.T
        n = min(n, near.shape[1])
        return np.argsort(-near, axis=1, kind="stable")[:, :n]

    def codes(self, v: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(v / self.step), -127, 127).astype(np.int8)


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1.0)


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as a matrix of unit rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return _unit(np.nan_to_num(flat).reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def fit(rows: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Quantiser:
    """Fits on the ``sample_rows`` rows with the least hash of their id: that
    many vectors at most come to the driver, however large the table is."""
    sample = rows.where("v IS NOT NULL").select("v").orderBy(F.xxhash64(rows["vec_id"]), rows["vec_id"]).limit(sample_rows).toArrow()
    v = _matrix(sample.column(0).combine_chunks()) if sample.num_rows else np.zeros((1, 1))
    rng = np.random.default_rng(seed)
    apart = np.unique(v, axis=0)
    cells = min(cells or int(len(v) ** 0.5), MOST_CELLS, len(apart))
    centres = apart[rng.choice(len(apart), cells, replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(v @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        held = np.linalg.norm(sums, axis=1) > 0
        centres[held] = _unit(sums[held])
    return Quantiser(centres, max(float(np.quantile(np.abs(v), CLIPPED)), 1e-9) / 127)


def _per_row(make: Callable[[np.ndarray], list[pa.Array]], names: list[str]) -> Callable:
    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                *kept, v = batch.columns
                yield pa.RecordBatch.from_arrays([*kept, *make(_matrix(v))], names=names)

    return go


def encoded(rows: DataFrame, id_col: str, v: str, key: Column) -> DataFrame:
    """(id, key, code): unit vectors as bytes of doubles, each worked out once."""
    make = lambda m: [pa.array([r.tobytes() for r in m], pa.binary())]
    held = rows.where(F.col(v).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), key.cast("string").alias("key"), v)
    return held.mapInArrow(_per_row(make, [id_col, "key", "code"]), f"{id_col} long, key string, code binary")


def build(rows: DataFrame, path: str, quantiser: Quantiser | None = None, k: int = 5, target: float = TARGET) -> None:
    """Writes the index of ``rows`` (vec_id, v) to ``path``: every row with a
    vector is in exactly one list. All vectors have one length; zero vectors
    are indexed, null ones left out. Repeated ids are kept as they are."""
    q = quantiser or fit(rows)

    def make(m: np.ndarray) -> list[pa.Array]:
        return [pa.array(q.cells(m, 1)[:, 0].astype(np.int32)), pa.array([r.tobytes() for r in q.codes(m)], pa.binary())]

    spark = rows.sparkSession
    held = rows.where("v IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    lists = held.mapInArrow(_per_row(make, ["vec_id", "cell", "code"]), "vec_id long, cell int, code binary")
    # ranges, so that a large cell is written by many tasks and a small one into one file
    lists.repartitionByRange("cell", "vec_id").write.partitionBy("cell").parquet(f"{path}/lists")
    held.write.parquet(f"{path}/vectors")
    lists, exact = _tables(spark, path)
    probes = _needed(lists, exact, q, k, target)
    cells = [(i, c.tolist(), q.step, probes) for i, c in enumerate(q.centres)]
    spark.createDataFrame(cells, "cell int, centre array<double>, step double, probes int").coalesce(1).write.parquet(f"{path}/cells")


def _needed(lists: DataFrame, exact: DataFrame, q: Quantiser, k: int, target: float) -> int:
    """How many lists hold ``target`` of the ``k`` neighbours of ``TRIED`` rows."""
    tried = exact.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(TRIED).selectExpr("vec_id AS q_id", "v AS qv")
    true = exact_top_k(tried, exact, k, others=True).select("q_id", "vec_id").join(lists.select("vec_id", "cell"), "vec_id")
    rows = true.join(tried, "q_id").select("cell", "qv").toArrow()  # TRIED times k rows
    if not rows.num_rows:
        return 1
    order = q.cells(_matrix(rows.column("qv").combine_chunks()), len(q.centres))
    rank = np.argmax(order == rows.column("cell").to_numpy()[:, None], axis=1)
    return int(np.quantile(rank, target, method="higher")) + 1


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema("vec_id long, code binary, cell int").parquet(f"{path}/lists"), spark.read.parquet(f"{path}/vectors")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, Quantiser, int]:
    """(lists, vectors, quantiser, number of lists to read) of a written index."""
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # MOST_CELLS rows at most
    return *_tables(spark, path), Quantiser(np.array([c.centre for c in cells]), cells[0].step), cells[0].probes


def _best(scores: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the ``keep`` best scores of a row, ties by id."""
    if len(scores) > keep:
        among = np.flatnonzero(scores >= np.partition(scores, -keep)[-keep])
    else:
        among = np.arange(len(scores))
    among = among[np.isfinite(scores[among])]
    return among[np.lexsort((ids[among], -scores[among]))][:keep]


def _block(keep: int, dtype: str, step: float, others: bool) -> Callable:
    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, ids = (t.column(n).to_numpy() for t, n in ((left, "q_id"), (right, "vec_id")))
        out = [], [], []
        if len(q_ids) and len(ids):
            q = np.stack([np.frombuffer(c.as_py(), float) for c in left.column("code")])
            v = np.frombuffer(b"".join(right.column("code").to_pylist()), dtype).reshape(len(ids), -1).astype(np.float64)
            for at in range(0, len(q_ids), AT_ONCE):
                scores = np.round(q[at : at + AT_ONCE] @ v.T * step, 9)
                for q_id, row in zip(q_ids[at : at + AT_ONCE], scores, strict=True):
                    if others:
                        row[ids == q_id] = -np.inf
                    best = _best(row, ids, keep)
                    out[0].extend([q_id] * len(best))
                    out[1].extend(ids[best])
                    out[2].extend(row[best])
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["q_id", "vec_id", "near"])

    return go


def candidates(queries: DataFrame, rows: DataFrame, keep: int, dtype: str = "f8", step: float = 1.0, others: bool = False) -> DataFrame:
    """(q_id, vec_id, near): the ``keep`` best rows of each query among those
    of equal ``key``. ``queries`` has q_id, key and code (doubles), ``rows``
    vec_id, key and code (of ``dtype``); ``others`` leaves out the query's own id."""
    count = lambda df, n: df.groupBy("key").agg(F.count("*").alias(n))
    cut = lambda n, most: F.greatest(F.ceil(F.col(n) / most), F.lit(1)).cast("int")
    sizes = count(queries, "n_q").join(count(rows, "n_r"), "key").select("key", cut("n_q", QUERY_ROWS).alias("blocks"), cut("n_r", LIST_ROWS).alias("pieces"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = queries.join(sizes, "key").select("key", deal("q_id", "blocks").alias("block"), numbers("pieces").alias("piece"), "q_id", "code")
    right = rows.join(sizes, "key").select("key", numbers("blocks").alias("block"), deal("vec_id", "pieces").alias("piece"), "vec_id", "code")
    by = ["key", "block", "piece"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_block(keep, dtype, step, others), "q_id long, vec_id long, near double")
    return _top(found, "near", keep)


def _top(found: DataFrame, score: str, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("q_id").orderBy(F.desc(score), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _exactly(found: DataFrame, queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    both = found.select("q_id", "vec_id").join(queries.select("q_id", "qv"), "q_id").join(rows.select("vec_id", "v"), "vec_id")
    return _top(both.select("q_id", "vec_id", vectors.dot(vectors.normalised(F.col("qv")), vectors.normalised(F.col("v"))).alias("score")), "score", k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, probes: int | None = None, others: bool = False) -> DataFrame:
    """(q_id, vec_id, score, rank): cosine neighbours of ``queries`` (q_id, qv)
    among the rows in the ``probes`` lists nearest to each, as many as the index
    found to be needed if left out. Queries without a
    vector find nothing; equal scores are ranked by id."""
    lists, exact, q, needed = read(spark, path)
    probes = probes or needed

    def make(m: np.ndarray) -> list[pa.Array]:
        return [pa.array(q.cells(m, probes).tolist(), pa.list_(pa.int32())), pa.array([r.tobytes() for r in m], pa.binary())]

    asked = queries.where("qv IS NOT NULL").select(F.col("q_id").cast("long").alias("q_id"), "qv")
    probed = asked.mapInArrow(_per_row(make, ["q_id", "cells", "code"]), "q_id long, cells array<int>, code binary").select("q_id", F.explode("cells").alias("key"), "code")
    # each query's codes are doubles, the rows' are steps: the query stays as it is
    found = candidates(probed, lists.withColumnRenamed("cell", "key"), FINDS * k, "i1", q.step, others)
    return _exactly(found, asked, exact, k)


def exact_top_k(queries: DataFrame, rows: DataFrame, k: int = 5, q_key: Column | None = None, key: Column | None = None, others: bool = False) -> DataFrame:
    """As ``search``, over all rows (vec_id, v) whose ``key`` equals the
    query's. Rows of a null key meet nothing; ids should not repeat."""
    one = F.lit("")
    found = candidates(encoded(queries, "q_id", "qv", one if q_key is None else q_key), encoded(rows, "vec_id", "v", one if key is None else key), FINDS * k, others=others)
    return _exactly(found, queries, rows, k)
