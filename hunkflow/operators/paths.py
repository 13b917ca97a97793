"""What paths say: the wider classes of the package variant, and renamed packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def _artifact(path: Column) -> Column:
    hidden = F.exists(F.split(path, "/"), lambda p: p.startswith(".") & ~p.isin(R.INFRA_DOT_DIRS))
    return T.matches(path, R.AGENT_ROOT_FILES) | T.matches(path, R.IGNORED_PATHS) | hidden


def _root_config(path: Column) -> Column:
    return ~path.contains("/") & T.matches(path, R.ROOT_CONFIG_FILES)


def path_class(path: Column) -> Column:
    """FLT-18: artifact, test, source, config or docs."""
    return (
        F.when(_artifact(path), "artifact").when(T.matches(path, R.WIDE_TEST_FILE), "test").when(T.matches(path, R.WIDE_SOURCE_FILE), "source")
        .when(T.matches(path, R.WIDE_CONFIG_FILE) | _root_config(path), "config").otherwise("docs")
    )


def not_functional(path: Column) -> Column:
    """FLT-18: whether changes of the file do nothing."""
    return F.when(_artifact(path), True).when(_root_config(path), False).otherwise(T.matches(path, R.WIDE_DOCS_FILE))


def is_source(path: Column) -> Column:
    """FLT-5: whether the registry knows the file's language; tests count."""
    return T.language(path).isNotNull()


def rebrands(lines: DataFrame) -> DataFrame:
    """FLT-19: (scan_id, rebrand): whether a hunk of a package.json gives the
    package another name. The last name on either side of a hunk counts."""
    package = F.rlike("path", F.lit(r"(?i)package\.json$"))
    name = F.when(package, F.regexp_extract("body", r'"name":\s*"(.+?)"', 1))
    # one pass: lines with a name, and of every other hunk the first line alone
    rows = lines.select("scan_id", "file_idx", "hunk_idx", "line_idx", "marker", name.alias("name")).where("line_idx = 0 OR name <> ''")
    side = lambda m: F.max_by("name", F.when((F.col("marker") == m) & (F.col("name") != ""), F.col("line_idx")))
    hunks = rows.groupBy("scan_id", "file_idx", "hunk_idx").agg(side("-").alias("old"), side("+").alias("new"))
    return hunks.groupBy("scan_id").agg(F.max(F.coalesce((F.col("old") != F.col("new")), F.lit(False))).alias("rebrand"))
