"""Measures of detectors against labels, splits and gates."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered

_M = 0xFFFFFFFF
MOST_GROUPS = 100_000  # names that the driver shuffles


def confusion(predicted: DataFrame, detectors: list[str], actual: str = "actual") -> DataFrame:
    """(detector, tp, fp, tn, fn). ``predicted`` has a boolean per detector."""
    long = predicted.select(actual, F.explode(F.array(*(F.struct(F.lit(d).alias("detector"), F.col(d).alias("hit")) for d in detectors))).alias("p")).select(F.col(actual).alias("y"), "p.*")
    return long.groupBy("detector").agg(F.count_if(F.expr("hit AND y")).alias("tp"), F.count_if(F.expr("hit AND NOT y")).alias("fp"), F.count_if(F.expr("NOT hit AND NOT y")).alias("tn"), F.count_if(F.expr("NOT hit AND y")).alias("fn"))


def percent(share: Column) -> Column:
    return F.floor(share * 1000 + 0.5) / 10


def metrics(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and F1 in per cent, 0 where undefined."""
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    p, r = safe(F.col("tp"), F.col("tp") + F.col("fp")), safe(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": percent(p), "recall": percent(r), "f1": percent(safe(2 * p * r, p + r))})


def gate(baseline: DataFrame, now: DataFrame, drop: float = 5.0) -> DataFrame:
    """Per detector, whether precision or recall fell by more than ``drop``."""
    old = baseline.select("detector", F.col("precision").alias("old_precision"), F.col("recall").alias("old_recall"))
    joined = now.join(old, "detector", "left")
    return joined.withColumn("failed", F.coalesce((F.col("old_precision") - F.col("precision") > drop) | (F.col("old_recall") - F.col("recall") > drop), F.lit(False)))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """EV-13: how the measures of two runs of the same detectors differ."""
    old = before.select("detector", *(F.col(c).alias(f"old_{c}") for c in ("precision", "recall", "f1")))
    joined = after.join(old, "detector", "full")
    return joined.select("detector", *(F.round(F.coalesce(c, F.lit(0.0)) - F.coalesce(f"old_{c}", F.lit(0.0)), 1).alias(f"{c}_delta") for c in ("precision", "recall", "f1")))


def sample(rows: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """SL-10: a fixed sample of the given share of the rows, one at least: the
    first by a hash of key and seed, a top-k that no task holds as a whole."""
    n = max(1, math.ceil(share * rows.count()))
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def auto_label(findings: Column, score: Column) -> Column:
    """EV-7: (label, confidence, reason) of a scored change set that nobody has
    labelled. Only clean ones are confirmed; none is called deceptive unseen."""
    case = lambda label, sure, reason: F.struct(F.lit(label).alias("label"), F.lit(sure).alias("confidence"), F.lit(reason).alias("reason"))
    review = lambda reason: case("PENDING_REVIEW", "low", reason)
    none = findings == 0
    return F.when(none & (score >= 80), case("CONFIRMED_LEGIT", "high", "clean")).when(none, review("anomaly")).when((score >= 70) & (findings <= 2), review("maybe_false")).otherwise(review("manual"))


LABELS = ("CONFIRMED_DECEPTIVE", "CONFIRMED_LEGIT", "AMBIGUOUS")


def import_labels(known: DataFrame, rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """EV-9: labels to append, and how many rows were what. ``known`` has id
    (``gt_`` and a number) and url, ``rows`` url, label, notes and repo, read in
    the order of the columns ``order``. Rows without url or label and urls that are
    known are skipped, other labels are invalid; ids go on after the largest."""
    trimmed = rows.withColumns({"url": F.trim("url"), "label": F.upper(F.trim("label"))})
    seen = known.select(F.col("url").alias("_url"), F.lit(True).alias("_seen")).distinct()
    blank = F.coalesce(F.col("url") == "", F.lit(True)) | F.coalesce(F.col("label") == "", F.lit(True))
    state = F.when(blank, "skipped").when(~F.col("label").isin(*LABELS), "invalid").when(F.col("_seen"), "skipped").otherwise("new")
    judged = trimmed.join(seen, F.col("url") == F.col("_url"), "left").withColumn("state", state)
    last = known.agg(F.max(F.try_to_number(F.regexp_extract("id", r"^gt_(\d+)", 1), F.lit("999999999999")))).first()[0]
    repo = F.when(F.coalesce(F.col("repo"), F.lit("")) != "", F.col("repo")).otherwise(F.regexp_extract("url", r"^(?:https://github\.com/)?([^/]*(?:/[^/]*)?)", 1))
    new = numbered(judged.where("state = 'new'").select(*dict.fromkeys([*order, "url", "label", "notes", "repo"])), order, "number", int(last or 0) + 1)
    new = new.select(F.concat(F.lit("gt_"), F.when(F.col("number") < 10_000, F.lpad(F.col("number").cast("string"), 4, "0")).otherwise(F.col("number").cast("string"))).alias("id"), repo.alias("repo"), "url", "label", "notes")
    return new, judged.groupBy("state").agg(F.count("*").alias("n"))


def suggested_weight(f1: Column) -> Column:
    return F.when(f1 == 0, 0).otherwise(F.least(F.lit(15), F.greatest(F.lit(0), F.floor(f1 * 20 + 0.5))))


def mulberry32(seed: int) -> Iterator[float]:
    """The well-known 32-bit generator of that name: numbers in [0, 1)."""
    a = seed & _M
    while True:
        a = (a + 0x6D2B79F5) & _M
        t = ((a ^ a >> 15) * (a | 1)) & _M
        t = (t ^ (t + (((t ^ t >> 7) * (t | 61)) & _M))) & _M
        yield (t ^ t >> 14) / 4294967296


def shuffled(items: list, seed: int) -> list:
    out, random = list(items), mulberry32(seed)
    for i in range(len(out) - 1, 0, -1):
        j = math.floor(next(random) * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def holdout_split(rows: DataFrame, group: str = "repo", train: float = 0.7, seed: int = 42) -> DataFrame:
    """Adds ``part``: whole groups go to train or holdout. The groups' names,
    a bounded dimension, are shuffled on the driver to reproduce the split."""
    found = rows.select(group).distinct().where(F.col(group).isNotNull()).limit(MOST_GROUPS + 1).collect()
    if len(found) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups: split by a hash of the group instead")
    names = shuffled(sorted(r[0] for r in found), seed)
    chosen = names[: math.ceil(train * len(names))]
    return rows.withColumn("part", F.when(F.col(group).isin(chosen), "train").otherwise("holdout"))
