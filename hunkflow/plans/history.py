"""Stateful operators, patches and large-hunk scores as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patches
from ..sources import change_sets, diffs
from ..streaming import author_events as A
from . import scan


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def st_rate_limited(spark, sf_dir):
    return A.rate_limited(_events(spark, sf_dir), "share")


def st_profiles(spark, sf_dir):
    return A.profiles(_events(spark, sf_dir))


def st_tumbling(spark, sf_dir):
    return A.windowed(_events(spark, sf_dir)).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def st_sessions(spark, sf_dir):
    return A.sessions(_events(spark, sf_dir)).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def _findings(spark, sf_dir):
    scans = change_sets.change_sets(spark, sf_dir)
    return scan.found_of(diffs.parse_lines(scans), scans), scans


def hl_patches(spark, sf_dir):
    return patches.suggest(_findings(spark, sf_dir)[0]).drop("seq")


def hl_patched_diffs(spark, sf_dir):
    found, scans = _findings(spark, sf_dir)
    return patches.apply_to_diff(scans, patches.suggest(found))


#: Credits last three days here, so that the month of the shared events has resets.
LEDGER_DAYS, LEASE_SECONDS = 3, 86_400


def st_ledger_periods(spark, sf_dir):
    return A.ledger(_events(spark, sf_dir), costs={"purchase": 3, "signup": 7}, days=LEDGER_DAYS)


def st_leases(spark, sf_dir):
    """A user's events are the arrivals of one delivery, a purchase completes it."""
    events = _events(spark, sf_dir)
    return A.leases(events.select(F.col("user_id").cast("string").alias("delivery_id"), "ts", "event_id", (F.col("event_type") == "purchase").alias("done")), LEASE_SECONDS)


def ag_running_rounded(spark, sf_dir):
    return A.running_mean(_events(spark, sf_dir)).select("user_id", "mean")


QUERIES = {
    "st_ledger_periods": st_ledger_periods,
    "st_leases": st_leases,
    "ag_running_rounded": ag_running_rounded,
    "st_rate_limited": st_rate_limited,
    "st_profiles": st_profiles,
    "st_tumbling": st_tumbling,
    "st_sessions": st_sessions,
    "hl_patches": hl_patches,
    "hl_patched_diffs": hl_patched_diffs,
}

_CASES = patches.rule_cases()
_PATCHES = (
    f"WITH {scan._ALL}, {scan.FOUND_SQL}, pl AS (SELECT DISTINCT path, lang FROM fl), p1 AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY scan_id, path, line_start, pattern_type ORDER BY seq) = 1), "
    f"p2 AS (SELECT *, CASE {' '.join(f'WHEN {c} THEN {fixed}' for c, fixed, _ in _CASES)} END AS fixed, CASE {' '.join(f"WHEN {c} THEN '{risk}'" for c, _, risk in _CASES)} END AS risk FROM p1 LEFT JOIN pl USING (path))"
)
ORACLE_SQL = {
    "ag_running_rounded": "SELECT user_id, list_reduce(list_prepend([0, 0]::DOUBLE[], list([1, value] ORDER BY ts, event_id)), lambda a, b: [a[1] + 1, floor((a[2] * a[1] + b[2]) / (a[1] + 1) + 0.5)])[2] AS mean FROM events GROUP BY user_id",
    "st_ledger_periods": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 7 ELSE 2 END AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      r(user_id, event_id, n, pe, reset, before, cost) AS (SELECT user_id, event_id, n, us + {LEDGER_DAYS} * 86400000000, false, {A.FREE}, cost FROM e WHERE n = 1 UNION ALL
        SELECT e.user_id, e.event_id, e.n, CASE WHEN us > pe THEN us + {LEDGER_DAYS} * 86400000000 ELSE pe END, us > pe, CASE WHEN us > pe THEN {A.FREE} WHEN r.cost <= before THEN before - r.cost ELSE before END, e.cost FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
      SELECT user_id, event_id, cost <= before AS allowed, CASE WHEN cost <= before THEN before - cost ELSE before END::INT AS balance, reset, CASE WHEN cost <= before THEN -cost ELSE 0 END::INT AS amount FROM r""",
    "st_leases": f"""WITH a AS (SELECT *, event_type = 'purchase' AS done, min(CASE WHEN event_type <> 'purchase' THEN ts END) OVER u AS begun FROM events WINDOW u AS (PARTITION BY user_id)),
      b AS (SELECT *, min(CASE WHEN done AND ts > begun THEN ts END) OVER (PARTITION BY user_id) AS ended FROM a)
      SELECT user_id::VARCHAR AS delivery_id, event_id, CASE WHEN done THEN CASE WHEN ts = ended THEN 'completed' ELSE 'ignored' END WHEN ts = begun THEN 'accepted' WHEN ts > ended THEN 'skipped'
        WHEN epoch_us(ts) - epoch_us(begun) < {LEASE_SECONDS * 1_000_000} THEN 'processing' ELSE 'retried' END AS status FROM b""",
    "st_tumbling": "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL",
    "st_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""",
    "st_rate_limited": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      r(user_id, event_id, n, times, left_) AS (SELECT user_id, event_id, n, [us], 3 FROM e WHERE n = 1 UNION ALL
        SELECT user_id, event_id, n, CASE WHEN left_ > 0 THEN list_append(kept, us) ELSE kept END, left_ FROM (SELECT e.user_id, e.event_id, e.n, us, list_filter(times, lambda t: t > us - 3600000000) AS kept, 3 - len(list_filter(times, lambda t: t > us - 3600000000)) AS left_
          FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
      SELECT user_id, event_id, left_ > 0 AS allowed, greatest(left_, 0)::INT AS remaining FROM r""",
    "st_profiles": """WITH v AS (SELECT user_id, list_reduce(list_prepend([0, 0, 0, 0]::DOUBLE[], list([1, value, 0, 0] ORDER BY ts, event_id)), lambda a, b:
        [a[1] + 1, floor((a[2] * a[1] + b[2]) / (a[1] + 1) + 0.5), CASE WHEN b[2] >= 70 THEN 0 ELSE a[3] + 1 END,
         least(100, greatest(0, a[4] + CASE WHEN b[2] < 70 AND a[3] + 1 >= 3 THEN least(3 * (a[3] + 1), 12) / 2 ELSE -5 END))]) AS p FROM events GROUP BY user_id)
      SELECT user_id, p[1]::INT AS scans, p[2]::INT AS mean_value, p[3]::INT AS failures, p[4] AS suspicion FROM v""",
    "hl_patches": f"{_PATCHES} SELECT scan_id, path, line_start, pattern_type, evidence AS original, fixed, risk FROM p2 WHERE risk IS NOT NULL",
    "hl_patched_diffs": f"""{_PATCHES}, p3 AS (SELECT scan_id, list({{'o': evidence, 'f': fixed}} ORDER BY -line_start, seq) AS p FROM p2 WHERE risk IS NOT NULL AND evidence <> '' GROUP BY scan_id)
      SELECT scan_id, CASE WHEN p IS NULL THEN raw_diff ELSE list_reduce(list_prepend({{'o': raw_diff, 'f': ''}}, p), lambda a, b: {{'o': replace(a.o, b.o, b.f), 'f': ''}}).o END AS patched FROM change_sets LEFT JOIN p3 USING (scan_id)""",
}
