"""JSON-lines and CSV files with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANDIDATE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("scraped_at", "source", "repo", "pr_url", "pr_title", "pr_author", "pr_created_at", "pr_updated_at")]
    + [T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("diff_length_chars", T.IntegerType()), T.StructField("diff_snippet", T.StringType())]
)
_CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = CANDIDATE, required: str | None = "diff_snippet", strict: bool = False) -> DataFrame:
    """Rows of a JSON-lines file. Malformed lines and rows without the required
    field are skipped; with ``strict`` a malformed line raises."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT).json(path)
    rows = rows.select(*wide.names).where(F.col(_CORRUPT).isNull())
    return (rows.where(F.col(required).isNotNull()) if required else rows).drop(_CORRUPT)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, least_columns: int = 8) -> DataFrame:
    """Rows of a CSV file with a header; fields are trimmed, and rows with fewer
    than ``least_columns`` fields are skipped. An empty field is the empty string
    where it is text, else null; a row is judged by its fields, filled in or not."""
    wide = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    rows = spark.read.schema(wide).csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT, emptyValue="", nullValue="\x00", enforceSchema=True)
    # a row that lacks fields is kept as it stood; quoted commas separate nothing
    bare = F.regexp_replace(_CORRUPT, r'"(?:[^"]|"")*"', "")
    fields = F.when(F.col(_CORRUPT).isNull(), len(schema)).otherwise(F.regexp_count(bare, F.lit(",")) + 1)
    empty = [F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema.fields]
    return rows.where(fields >= min(least_columns, len(schema))).select(*empty)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True, quote='"', escape='"')


def truncate_at_hunk(diff, most: int = 50_000):
    """The longest prefix of at most ``most`` characters that ends before a
    hunk header, or the bare prefix where there is none."""
    head = F.substring(diff, 1, most)
    cut = F.regexp_extract(head, r"(?s)^(.*)\n@@ ", 1)
    return F.when(F.char_length(diff) <= most, diff).when(cut != "", cut).otherwise(head)
