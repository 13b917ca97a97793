"""Sharding by extendible hashing, with DataFrame operations only.

A bucket is a prefix of the bits of a row's hash. All rows begin in one
bucket; only buckets over the byte limit split on the next bit, until each
fits. The directory (prefix -> shard) stays a table: it is built eight bits a
round from sums over hash cells, and rows meet it in an equi-join.

The hash of a row is 56 bits of its key followed by 56 bits of its position
in the input, so that rows which share a key part only when their bucket is
still too large after all bits of the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, partitions, table, text_or_empty

STEP = 8  # bits a round: two hexadecimal digits
DIGITS = 14  # hexadecimal digits of either half of the hash
LIMIT = 16 << 20


def _hash_digits(col):
    return F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, DIGITS)


def assign_shards(df: DataFrame, limit: int = LIMIT, key: str = "doc_id", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per input row: ``carry``, ``n_bytes``, ``shard`` (bits of the
    bucket, empty for the root), ``depth``, ``shard_bytes``, ``shard_rows``.

    A null text counts no bytes and a null key hashes as the empty string. A
    row over the limit gets a shard of its own: it is the only kind of shard
    that exceeds the limit. Repeated rows are separate rows. An empty table
    gives no rows. Columns beside ``carry``, ``key`` and ``text`` are ignored;
    ``carry`` may not hold the names of the new columns (see ``write_shards``).
    """
    return _dealt(df, limit, key, carry).select("row.*", "n_bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows")


def _dealt(df: DataFrame, limit: int, key: str, carry: Sequence[str]) -> DataFrame:
    """(row: struct of ``carry``, n_bytes, shard, depth, shard_bytes, shard_rows)."""
    rows = materialise(
        df.select(
            F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"),
            F.octet_length(text_or_empty()).cast("long").alias("n_bytes"),
            F.concat(_hash_digits(F.col(key)), _hash_digits(F.monotonically_increasing_id())).alias("h"),
        )
    )
    total = rows.agg(F.sum("n_bytes"), F.count("*")).first()
    if (total[0] or 0) <= limit or total[1] == 1:
        return rows.select("row", "n_bytes", F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(total[0] or 0).cast("long").alias("shard_bytes"), F.lit(total[1]).cast("long").alias("shard_rows"))
    directories, open_cells, done = [], None, 0
    while done < 2 * DIGITS:
        cells = _split(rows, open_cells, done, limit)
        done += STEP // 4
        last = done >= 2 * DIGITS
        directories.append((done, cells if last else cells.where("shard IS NOT NULL")))
        open_cells = cells.where("shard IS NULL").select("cell")
        if last or open_cells.isEmpty():
            break
    placed = [
        rows.withColumn("cell", F.substring("h", 1, d)).join(directory, "cell").select("row", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows")
        for d, directory in directories
    ]
    return reduce(DataFrame.unionAll, placed)


def _split(rows: DataFrame, open_cells: DataFrame | None, done: int, limit: int) -> DataFrame:
    """Cells of ``done`` digits and one more byte below the open buckets.
    ``shard`` is null where even the longest prefix exceeds the limit."""
    parent = F.substring("h", 1, done)
    inside = rows if open_cells is None else rows.join(open_cells.withColumnRenamed("cell", "parent"), parent == F.col("parent"), "left_semi")
    cells = inside.groupBy(F.substring("h", 1, done + STEP // 4).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    bits = F.lpad(F.conv(F.substring("cell", done + 1, 2), 16, 2), STEP, "0")
    before = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(done)), lambda i: F.lpad(F.conv(F.substring(F.col("cell"), i, F.lit(1)), 16, 2), 4, "0")), "") if done else F.lit("")
    levels = cells.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(STEP))))
    levels = levels.withColumn("node", F.expr(f"level * 256 + shiftright(cast(conv(substring(cell, {done + 1}, 2), 16, 10) as int), {STEP} - level)"))
    sums = levels.groupBy(F.substring("cell", 1, done).alias("up"), "node").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    best = (
        levels.withColumn("up", F.substring("cell", 1, done))
        .join(fits, ["up", "node"])
        .groupBy("cell")
        .agg(F.min(F.struct("level", "shard_bytes", "shard_rows")).alias("s"))
    )
    if done + STEP // 4 >= 2 * DIGITS:  # no bits are left: what remains is one bucket
        whole = F.struct(F.lit(STEP).alias("level"), F.col("b").alias("shard_bytes"), F.col("n").alias("shard_rows"))
    else:
        whole = F.lit(None)
    out = cells.join(best, "cell", "left").withColumn("s", F.coalesce("s", whole))
    return materialise(
        out.select(
            "cell",
            F.when(F.col("s").isNotNull(), F.concat(before, F.substring(bits, F.lit(1), F.col("s.level")))).alias("shard"),
            (F.lit(done * 4) + F.col("s.level")).cast("int").alias("depth"),
            "s.shard_bytes",
            "s.shard_rows",
        )
    )


def write_shards(df: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id") -> None:
    """Write the rows of ``df`` under ``path``, one folder ``shard=b<bits>``
    per shard, each written by one task.

    Columns of any name may be there: where ``df`` has a column ``shard``, the
    folders are called ``_shard=...`` instead. Null, empty and repeated rows
    are written like others; an empty table writes no folder.
    """
    name = free_name(df, "shard")
    dealt = materialise(_dealt(df, limit, key, df.columns).select("row", F.concat(F.lit("b"), "shard").alias("shard")))
    n = partitions(df.sparkSession, dealt.select("shard").distinct().count(), 4)
    dealt.repartition(n, "shard").select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)


def op1_shard(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents"))


def shards_of_64k(spark, sf_dir):
    """The same with a small limit, so that small tables split as well."""
    return assign_shards(table(spark, sf_dir, "documents"), 1 << 16)


def shards_sql(limit: int) -> str:
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {DIGITS}))::BIGINT AS h
  FROM documents),
l AS (
  SELECT level, h // (1::BIGINT << ({DIGITS * 4} - level)) AS node, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
  FROM d, range(0, 40) r(level) GROUP BY ALL HAVING sum(n_bytes) <= {limit} OR count(*) = 1),
a AS (
  SELECT d.doc_id, d.n_bytes, d.h, min(l.level) AS depth
  FROM d JOIN l ON l.node = d.h // (1::BIGINT << ({DIGITS * 4} - l.level)) GROUP BY ALL)
SELECT a.doc_id, a.n_bytes, left(lpad(bin(a.h), {DIGITS * 4}, '0'), a.depth) AS shard, a.depth::INT AS depth, l.shard_bytes, l.shard_rows
FROM a JOIN l ON l.level = a.depth AND l.node = a.h // (1::BIGINT << ({DIGITS * 4} - a.depth))
"""


OP1_SQL = shards_sql(LIMIT)
