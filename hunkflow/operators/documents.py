"""Words and word sequences of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

GRAM, STYLE_WORDS = 8, 20
MOST_BROADCAST = 100_000  # sequences of the benchmark that go to every task as they are


def _grams(rows: DataFrame, key: str) -> DataFrame:
    """(key, g): every run of ``GRAM`` words."""
    words = rows.select(key, F.explode(F.array(F.split("text", "[ \\n]+"))).alias("w")).where(F.size("w") >= GRAM)
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - (GRAM - 1)), lambda i: F.array_join(F.slice("w", i, GRAM), " "))
    return words.select(key, F.explode(runs).alias("g"))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, shared): how many different runs of words a document has
    in common with a benchmark item. A run is looked up where its document is read,
    and only those found are made distinct; a large benchmark is joined by shuffle."""
    wanted = _grams(benchmark, "item_id").distinct()
    small = wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    hits = _grams(documents, "doc_id").join(F.broadcast(wanted) if small else wanted, "g")
    return hits.select("doc_id", "item_id", "g").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9_ \\n]", ""), "[ \\n]+"), lambda w: w != "")


def _digest(top: Column) -> Column:
    return F.substring(F.md5(F.array_join(top, "|").cast("binary")), 1, 16)


def writing_style(documents: DataFrame) -> DataFrame:
    """(doc_id, style): a digest of a document's most frequent words, of equally
    frequent ones the first. A document's words are counted in its own row; only
    rows that share an id are brought together."""
    repeated = documents.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id"))
    if repeated.isEmpty():
        return _style_of_rows(documents)
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    alone, shared = documents.join(repeated, same, "left_anti"), documents.join(repeated, same, "left_semi")
    return _style_of_rows(alone).unionByName(_style_of_groups(shared))


def _style_of_rows(documents: DataFrame) -> DataFrame:
    one = lambda c: F.explode(F.array(c))
    places = F.array_sort(F.transform(_words(F.col("text")), lambda w, i: F.struct(w.alias("word"), i.alias("p"))))
    rows = documents.select("doc_id", one(places).alias("ws")).where(F.size("ws") > 0)
    # of the sorted words, where each begins: the next one's place gives the number
    begins = F.filter(F.transform("ws", lambda x, k: F.when((k == 0) | (F.get("ws", k - 1)["word"] != x["word"]), k)), lambda k: k.isNotNull())
    rows = rows.select("doc_id", "ws", one(begins).alias("at"))
    counted = F.transform("at", lambda k, j: F.struct((k - F.coalesce(F.get("at", j + 1), F.size("ws"))).alias("n"), F.get("ws", k)["p"].alias("p"), F.get("ws", k)["word"].alias("word")))
    top = F.slice(F.array_sort(counted), 1, STYLE_WORDS)
    return rows.select("doc_id", _digest(F.transform(top, lambda x: F.concat(x["word"], F.lit(":"), (-x["n"]).cast("string")))).alias("style"))


def _style_of_groups(documents: DataFrame) -> DataFrame:
    words = documents.select("doc_id", F.posexplode(_words(F.col("text"))).alias("pos", "word"))
    counted = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    ranked = counted.withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), "p"))).where(f"k <= {STYLE_WORDS}")
    top = F.transform(F.array_sort(F.collect_list(F.struct("k", "word", "n"))), lambda x: F.concat(x["word"], F.lit(":"), x["n"].cast("string")))
    return ranked.groupBy("doc_id").agg(_digest(top).alias("style"))
