"""From findings to penalties, trust scores and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rules as R
from ..functions import text as T


def dedup(findings: DataFrame) -> DataFrame:
    """One finding per (scan, path, line): the strongest, the earlier of equal
    ones, at the place of the first (``first_seq``)."""
    best = F.max_by(F.struct("pattern_type", "confidence", "importance", "kind"), F.struct(T.confidence_weight(F.col("confidence")).alias("w"), (-F.col("seq")).alias("s")))
    return findings.groupBy("scan_id", "path", "line_start").agg(best.alias("b"), F.min("seq").alias("first_seq")).select("scan_id", "path", "line_start", "b.*", "first_seq")


def base_penalty(pattern: Column, confidence: Column, profile: str = "engine") -> Column:
    pick = lambda p: F.when(confidence == "high", p[0]).when(confidence == "medium", p[1]).otherwise(p[2])
    out = None
    for name, p in R.PENALTIES[profile].items():
        out = F.when(pattern == name, pick(p)) if out is None else out.when(pattern == name, pick(p))
    rest = pick(R.DEFAULT_PENALTY[profile])
    return rest if out is None else out.otherwise(rest)


def fused(deduped: DataFrame, profile: str = "engine", fusion: bool = True) -> DataFrame:
    """Adds ``penalty``: repeated weak findings of one kind in a file count
    half from the second, a quarter from the sixth on. High ones count fully
    but take a rank."""
    cluster = W.partitionBy("scan_id", "path", "pattern_type")
    rank = F.row_number().over(cluster.orderBy("first_seq"))
    ranked = deduped.withColumns({"rank": rank, "cluster_seq": F.min("first_seq").over(cluster), "base": base_penalty(F.col("pattern_type"), F.col("confidence"), profile)})
    weak = (F.col("rank") > 1) & (F.col("confidence") != "high") & F.lit(fusion)
    base = F.when(weak & (F.col("rank") <= 5), T.round_half_up(F.col("base") * 0.5)).when(weak, T.round_half_up(F.col("base") * 0.25)).otherwise(F.col("base"))
    times = None
    for name, m in R.MULTIPLIERS.items():
        times = F.when(F.col("importance") == name, m) if times is None else times.when(F.col("importance") == name, m)
    return ranked.withColumn("penalty", base.cast("double") * times.otherwise(1.0))


def apply_verdicts(findings: DataFrame, verdict: Column) -> DataFrame:
    """Findings after a judge's verdicts: FALSE_POSITIVE ones go, CONTEXTUAL ones
    lose a level, all others (and those without a verdict) stay as they are."""
    judged = findings.withColumn("_verdict", F.coalesce(verdict, F.lit("VALID"))).where("_verdict <> 'FALSE_POSITIVE'")
    lower = F.when(F.col("confidence") == "high", "medium").otherwise("low")
    return judged.withColumn("confidence", F.when(F.col("_verdict") == "CONTEXTUAL", lower).otherwise(F.col("confidence"))).drop("_verdict")


def scores(findings: DataFrame, scans: DataFrame, files: DataFrame, profile: str = "engine", fusion: bool = True, min_score: int = 0, threshold: int = 70, deduplicate: bool = True) -> DataFrame:
    """One row per scan. ``files`` has (scan_id, files_scanned). A scan without
    files scores 100 and has no verdict.

    Penalties are added in the order of clusters and ranks: the order of a sum
    of doubles can decide a rounding tie. A score that is worked out again
    after verdicts or later findings takes them all (``deduplicate=False``)."""
    deduped = fused(dedup(findings) if deduplicate else findings.withColumn("first_seq", F.col("seq")), profile, fusion)
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("cluster_seq", "rank", "penalty"))), F.lit(0.0), lambda a, x: a + x["penalty"])
    level = lambda c: F.count_if(F.col("confidence") == c)
    summed = deduped.groupBy("scan_id").agg(F.count("*").alias("n"), level("high").alias("high"), level("medium").alias("medium"), level("low").alias("low"), T.round_half_up(total).cast("int").alias("penalty"))
    raw = findings.groupBy("scan_id").agg(F.count("*").alias("raw"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    out = scans.select("scan_id").join(files, "scan_id", "left").join(summed, "scan_id", "left").join(raw, "scan_id", "left")
    out = out.select("scan_id", zero("raw").alias("raw_findings"), zero("n").alias("findings"), zero("high").alias("high_count"), zero("medium").alias("medium_count"), zero("low").alias("low_count"), zero("files_scanned").alias("files_scanned"), zero("penalty").alias("penalty"))
    floor_ = F.greatest(F.when(F.col("findings") > 0, 30).otherwise(0), F.lit(min_score))
    ceiling = F.when(F.col("high_count") >= 2, 40).when(F.col("high_count") == 1, 60).when(F.col("medium_count") >= 3, 70).otherwise(100)
    score = F.when(F.col("files_scanned") == 0, 100).otherwise(F.least(F.greatest(floor_, 100 - F.least("penalty", F.lit(85))), ceiling))
    return verdict(out.withColumn("trust_score", score.cast("int"))).withColumn("passed", F.col("trust_score") >= threshold)


def verdict(scored: DataFrame) -> DataFrame:
    s, high = F.col("trust_score"), F.col("high_count")
    known = F.col("files_scanned") > 0
    label = F.when(known, F.when((s >= 80) & (high == 0), "CLEAN").when(s >= 50, "SUSPICIOUS").otherwise("LIKELY_DECEPTIVE"))
    sure = (
        F.when(F.col("verdict") == "CLEAN", F.when(s >= 95, "high").when(s >= 88, "medium").otherwise("low"))
        .when((F.col("verdict") == "SUSPICIOUS") & (s >= 80), "high")
        .when(F.col("verdict") == "SUSPICIOUS", F.when(s <= 60, "high").otherwise("medium"))
        .when(F.col("verdict") == "LIKELY_DECEPTIVE", F.when(s <= 30, "high").otherwise("medium"))
    )
    return scored.withColumn("verdict", label).withColumn("verdict_confidence", sure)
