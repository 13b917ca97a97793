"""Source files of a directory tree, for an index of what they define."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T

# fixed values: files that are indexed, and folders that are not
SUFFIXES = "ts tsx js jsx mjs cjs mts cts py pyw go rs java rb php swift kt kts".split()
TOP_FOLDERS = ["node_modules/", "vendor/", ".git/", "dist/", "build/", ".next/", "coverage/"]
INNER_FOLDERS = ["/node_modules/", "/__pycache__/"]


def source_files(spark: SparkSession, root: str, most_files: int | None = None) -> DataFrame:
    """(path, lang, size, content) of the source files under ``root``, paths
    relative to it. Suffixes go to the listing of files, folders are passed over
    by path, and contents are read for what is left only. ``most_files``: the
    first so many by path. A file of a language without rules has a null
    ``lang``; one that is not UTF-8 is read with replacement characters, and an empty
    one leaves no row."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(root)
    full = F.url_decode(F.regexp_replace(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")), r"^[a-z0-9]+:(?://[^/]*)?", ""))
    files = files.select(F.col("path").alias("full"), F.substring(full, F.lit(len(base) + 1), F.char_length(full)).alias("path"), F.col("length").alias("size"), "content")
    low = F.lower("path")
    for folder in TOP_FOLDERS:
        files = files.where(~low.startswith(folder))
    for folder in INNER_FOLDERS:
        files = files.where(~low.contains(folder))
    if most_files is not None:
        # a limit on rows of names only; contents are joined afterwards
        first = files.select("full", "path").orderBy("path").limit(most_files).select("full")
        files = files.join(first, "full", "left_semi")
    return files.select("path", T.language(F.col("path")).alias("lang"), "size", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def as_changes(files: DataFrame, repo: str) -> DataFrame:
    """Rows for ``deliveries.apply_changes``: every file as added."""
    place = F.row_number().over(W.partitionBy("path").orderBy("size"))
    return files.select(F.lit(repo).alias("repo"), F.col("path").alias("file"), "content", F.lit("added").alias("op"), place.cast("long").alias("at"))
