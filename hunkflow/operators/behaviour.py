"""D9: flags on an author's history. They inform and never change a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SETTLED = 3  # scans after which an author's habits are known
VOLATILE, RECENT_SCANS = 40, 5
MOST_A_DAY, KEPT_EVENTS = 10, 50
KEPT_STYLES, STYLE_CHANGE = 10, 0.7
FAILED_BELOW = 70
FLAGS = ("style_change", "odd_hours", "score_volatility", "new_author", "frequency_anomaly", "consecutive_failures")


def style_similarity(earlier: Column, style: Column) -> Column:
    """FN-19: share of the earlier styles that equal this one; 1 without any
    or for an empty title."""
    same = F.size(F.filter(earlier, lambda h: h == style))
    return F.when((F.size(earlier) == 0) | (style == "empty"), 1.0).otherwise(same / F.size(earlier))


def flags(scans: DataFrame) -> DataFrame:
    """One row per scan: ``event_id``, the modifier of each analyser (0 where it
    has nothing to say) and their sum ``modifier``. ``scans``: event_id, author,
    ts, score, style. Windows per author; an author's scans share a partition."""
    by = W.partitionBy("author").orderBy("ts", "event_id")
    # to the nearest second, halves to the even one
    second = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).cast("long")
    day = W.partitionBy("author").orderBy(second).rangeBetween(-86_400, 0)
    known = scans.withColumns({
        "scans": F.row_number().over(by), "failed": (F.col("score") < FAILED_BELOW).cast("int"), "swing": F.abs(F.col("score") - F.lag("score").over(by)),
        "passes": F.sum((F.col("score") >= FAILED_BELOW).cast("int")).over(by), "recent": F.least(F.count("*").over(day), F.lit(KEPT_EVENTS)),
        "styles": F.collect_list("style").over(by.rowsBetween(-KEPT_STYLES, -1)),
    })
    runs = W.partitionBy("author", "passes").orderBy("ts", "event_id")
    failures = F.when(F.col("failed") == 1, F.sum("failed").over(runs)).otherwise(0)
    swing = F.max("swing").over(by.rowsBetween(2 - RECENT_SCANS, 0))
    known = known.withColumns({"failures": failures, "worst": swing})
    hour, settled = F.hour("ts"), F.col("scans") > SETTLED
    each = {
        "style_change": F.when((F.size("styles") >= 2) & (style_similarity(F.col("styles"), F.col("style")) < 1 - STYLE_CHANGE), -3).otherwise(0),
        "odd_hours": F.when(settled & (hour >= 1) & (hour < 5), -3).otherwise(0),
        "score_volatility": F.when(F.col("worst") >= VOLATILE, -8).when(F.col("worst") >= VOLATILE / 2, -3).otherwise(0),
        "new_author": F.when(F.col("scans") == 1, -3).otherwise(0),
        "frequency_anomaly": F.when(settled & (F.col("recent") > MOST_A_DAY), -5).when(settled & (F.col("recent") > MOST_A_DAY / 2), -2).otherwise(0),
        "consecutive_failures": F.when(F.col("failures") >= 3, -F.least(3 * F.col("failures"), F.lit(12))).otherwise(0).cast("int"),
    }
    out = known.select("event_id", *(each[f].alias(f) for f in FLAGS))
    return out.withColumn("modifier", sum((F.col(f) for f in FLAGS[1:]), F.col(FLAGS[0])))
