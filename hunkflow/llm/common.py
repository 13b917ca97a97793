"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
BATCH_ROWS = 512
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    It is set here only where the session leaves it unset, and only for a
    local master: a machine-local folder would lose data on a cluster.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="hunkflow-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        path = "file://" + path
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_scratches: list[list[str]] = []  # tables written in each open ``scratch``, innermost last


def _folder(spark: SparkSession) -> str:
    """This application's own folder for tables; it goes with the driver."""
    path = f"{shared_dir(spark)}/hunkflow-{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders.add(path)
        atexit.register(_forget, spark, path)
    return path


_folders: set[str] = set()


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than the tasks that
    were running on it, and later steps read the same rows each time. The table
    is deleted by ``discard``, at the end of the ``scratch`` it was written in,
    or with the application.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratches:
        _scratches[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``materialise`` writes inside are deleted at the end, but for
    those handed to the function it gives."""
    mine: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.written_to)
        return df

    _scratches.append(mine)
    try:
        yield keep
    finally:
        _scratches.remove(mine)
        for path in mine:
            if path in kept:
                if _scratches:
                    _scratches[-1].append(path)
            else:
                _delete(spark, path)


def modest_batches(df: DataFrame) -> DataFrame:
    """Hand Python at most ``BATCH_ROWS`` rows at a time from now on: texts are
    long, and a batch exists several times over on its way."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def partitions(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Shuffle partitions so that none holds much more than ``per_partition`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


BROADCAST_ROWS = 100_000
SALTS = 64


def join_small(rows: DataFrame, small: DataFrame, keys: list[str], spread_by: list[str] | None = None) -> DataFrame:
    """Join on keys of which one may hold most of ``rows``. ``small`` has one
    short row per key and was materialised: up to ``BROADCAST_ROWS`` rows of it
    are broadcast, beyond that each key is spread over ``SALTS`` partitions, or
    more of them if there are more shuffle partitions. ``rows`` are dealt out
    among them by a hash of ``spread_by`` (all their columns if it is left out),
    so that a task which runs again deals as before."""
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), keys)
    salt = free_name(rows, "_salt")
    salts = max(SALTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)
    spread = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    by = F.xxhash64(*(F.col(f"`{c}`") for c in (spread_by or rows.columns)))
    return rows.withColumn(salt, F.pmod(by, F.lit(salts)).cast("int")).join(spread, [*keys, salt]).drop(salt)


def release(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files of jobs that nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, and release what made it."""
    _delete(df.sparkSession, df.written_to)
    release(df.sparkSession)


def worker_cache(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks. One cache lives at a time: a
    worker that moves on to another kind of task drops the last one's."""
    store = sys.modules.setdefault("_hunkflow_worker", types.ModuleType("_hunkflow_worker"))
    held = store.__dict__.get("held")
    if held is None or held[0] != name:
        store.__dict__["held"] = None
        held = store.__dict__["held"] = (name, make())
    return held[1]


def give_back() -> None:
    """Return freed memory to the system: a worker is used again by later
    stages, and would hold on to what a large task needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """A function for ``mapInArrow`` that gives memory back when it is done."""

    def go(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return go


class WordHashes(dict):
    """64-bit hashes of words, at most ``WORDS`` of them remembered."""

    WORDS = 120_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def hash_words(words: list[bytes]) -> np.ndarray:
    known = worker_cache("words", WordHashes)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
