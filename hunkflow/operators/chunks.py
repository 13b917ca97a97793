"""Files cut into chunks by the symbols they define."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def by_symbol(files: DataFrame) -> DataFrame:
    """(file_id, path, chunk, symbol, line_start, line_end, content): a chunk
    begins at a line that defines a symbol and ends before the next one; what
    stands before the first is chunk 0 without a symbol. A file of an unknown
    language, or without definitions, is one chunk. ``files``: file_id, path,
    content; a null content has no chunk. Files are cut in their own rows."""
    lines = files.select("file_id", "path", F.explode(F.array(T.language(F.col("path")))).alias("lang"), F.split("content", "\n").alias("lines")).where("lines IS NOT NULL")
    opens = lambda line: F.coalesce(T.by_language(F.col("lang"), R.SYMBOL_START, lambda p: T.matches(line, p)), F.lit(False))
    starts = F.filter(F.transform("lines", lambda line, i: F.when(opens(line), i)), lambda i: i.isNotNull())
    cut = lines.select("file_id", "path", "lines", F.explode(F.array(starts)).alias("starts"))
    # what stands before the first definition counts as chunk 0, if it is anything
    first = F.when(F.coalesce(F.get("starts", F.lit(0)) != 0, F.lit(True)), 0)
    cut = cut.select("file_id", "path", "lines", F.explode(F.array(F.struct(first.alias("before"), F.array_compact(F.concat(F.array(first), F.col("starts"))).alias("at")))).alias("s"))
    own = lambda at, k: F.struct(at.alias("at"), F.slice("lines", at + 1, F.coalesce(F.get("s.at", k + 1), F.size("lines")) - at).alias("text"))
    each = cut.select("file_id", "path", F.col("s.before").alias("before"), F.posexplode(F.transform("s.at", own)).alias("k", "c"))
    chunk = F.when(F.col("before").isNull(), F.col("k") + 1).otherwise(F.col("k"))
    symbol = F.when(chunk > 0, F.regexp_extract(F.get("c.text", F.lit(0)), R.SYMBOL_NAME, 1))
    return each.select("file_id", "path", chunk.cast("int").alias("chunk"), symbol.alias("symbol"), (F.col("c.at") + 1).cast("int").alias("line_start"), (F.col("c.at") + F.size("c.text")).cast("int").alias("line_end"), F.array_join("c.text", "\n").alias("content"))
