"""Written intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, which
    is set here only for a local master that leaves it unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="hunkflow-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        path = "file://" + path
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession) -> str:
    """A free path in the shared folder. What is written there goes with the
    application, or before by ``forget``."""
    path = f"{shared_dir(spark)}/hunkflow-core-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(lambda: [_forget(spark, p) for p in list(_paths)])
    _paths.add(path)
    return path


_paths: set[str] = set()


def stored(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read back: its rows are worked
    out once, and a lost executor costs the running tasks only. The table goes
    with the application, or before by ``forget``."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table that ``stored`` wrote."""
    _forget(df.sparkSession, df.written_to)
    _paths.discard(df.written_to)


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
