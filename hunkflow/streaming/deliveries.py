"""Deliveries from outside: verified events, and an index kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.digests import hmac_sha256
from ..sources.commits import Store

EVENT = T.StructType([T.StructField("action", T.StringType()), T.StructField("number", T.LongType()), T.StructField("repository", T.StringType()), T.StructField("sender", T.StringType())])
RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("delivery", "signature", "body")])
MOST_CONTENT = 8000
MOST_DELTAS = 20
INDEX, KEYS = "index", ["repo", "file"]


def verified(raw: DataFrame, secret: bytes, schema: T.StructType = EVENT) -> DataFrame:
    """Parsed bodies of the deliveries whose signature is right: ``delivery``
    and the fields of ``schema``. ``raw`` (stream or batch) has RAW's columns;
    a body that is no JSON, and any without a signature, is dropped."""
    signed = raw.where(F.col("signature") == F.concat(F.lit("sha256="), hmac_sha256(F.col("body"), secret)))
    parsed = signed.select("delivery", F.from_json("body", schema, {"mode": "PERMISSIVE"}).alias("e"), F.get_json_object("body", "$").isNotNull().alias("ok"))
    return parsed.where("ok").select("delivery", "e.*")


def ingest(raw: DataFrame, secret: bytes, path: str, checkpoint: str, schema: T.StructType = EVENT) -> StreamingQuery:
    """Takes in a stream of deliveries (say, of JSON files) batch by batch: those
    with a right signature go to the table ``events``, each delivery once in a
    batch, all others to ``rejected`` with the reason. Both are published by one
    commit; a batch that runs again is known by its number."""

    def take(batch: DataFrame, number: int) -> None:
        signed = F.coalesce(F.col("signature") == F.concat(F.lit("sha256="), hmac_sha256(F.col("body"), secret)), F.lit(False))
        parses = F.coalesce(F.get_json_object("body", "$").isNotNull(), F.lit(False))
        reason = F.when(F.col("signature").isNull(), "unsigned").when(~signed, "signature").when(~parses, "body")
        judged = batch.withColumn("reason", reason)
        good = verified(judged.where("reason IS NULL").select(*RAW.names), secret, schema).dropDuplicates(["delivery"])
        bad = judged.where("reason IS NOT NULL").select("delivery", "reason", F.sha2(F.coalesce("body", F.lit("")).cast("binary"), 256).alias("body_sha256"))
        Store(batch.sparkSession, path).commit({"events": good, "rejected": bad}, batch=("ingest", number))

    return raw.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_changes(changes: DataFrame, path: str, batch: tuple[str, int] | None = None, most_content: int | None = MOST_CONTENT) -> None:
    """Bring an index of files up to date. ``changes``: repo, file, content, op
    (``removed`` or anything else) and ``at``, by which the last one counts. A
    batch is appended as it is, whatever the size of the index, and published by
    one commit; readers merge. After ``MOST_DELTAS`` of them they are folded into
    one. Contents are cut to ``most_content`` characters (None: kept whole)."""
    store = Store(changes.sparkSession, path)
    content = F.col("content") if most_content is None else F.substring("content", 1, most_content)
    last = changes.groupBy(*KEYS).agg(F.max_by(F.struct(content.alias("content"), "op"), "at").alias("c")).select(*KEYS, "c.*")
    store.commit({INDEX: last}, batch=batch)
    if len(store.manifest()["tables"][INDEX]) > MOST_DELTAS:
        compact(store)


def compact(store: Store) -> None:
    """Folds the changes published so far into one folder; those that come in
    meanwhile stay behind it."""
    before = store.manifest()["tables"].get(INDEX, [])
    rows = read_index(store.spark, store.path)
    if rows is not None:
        folder = store.write(INDEX, rows.withColumn("op", F.lit("kept")))
        store.commit(replace=lambda tables: {INDEX: [folder, *(f for f in tables[INDEX] if f not in before)]} if set(before) <= set(tables[INDEX]) else {})


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """(repo, file, content) as of the last commit, or None before the first."""
    rows = Store(spark, path).read(INDEX, "repo string, file string, content string, op string", "place")
    if rows is None:
        return None
    last = rows.groupBy(*KEYS).agg(F.max_by(F.struct("content", "op"), "place").alias("c"))
    return last.where("c.op <> 'removed' OR c.op IS NULL").select(*KEYS, "c.content")


def keep_index(changes: DataFrame, path: str, checkpoint: str, most_content: int | None = MOST_CONTENT) -> StreamingQuery:
    """Apply a stream of changes batch by batch. A batch that is run again is
    known by its number and leaves the index as it is."""
    apply = lambda batch, number: apply_changes(batch, path, ("stream", number), most_content)
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
