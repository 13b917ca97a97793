"""Joins, aggregates, windows, top-k, set operations and evaluation measures
over the shared tables, one query per kind of operator.

Each text runs on Spark as it stands; where the oracle's dialect differs it
has a text of its own. Patterns are written without SQL escapes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def run_sql(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query that runs ``sql`` over the tables it names."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in TABLES:
            if name in sql:
                spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        return spark.sql(sql.replace("\\", "\\\\"))

    return query


#: Query over the shared tables: findings with a kind, a confidence and a place.
FINDINGS = """
f AS (SELECT l_orderkey AS scan_id, l_linestatus AS pattern, CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END AS confidence,
             l_suppkey AS path, l_partkey AS line, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) AS INT) AS seq FROM lineitem)"""
#: Predictions (a text rule) beside the labels.
JUDGED = """
j AS (SELECT d.doc_id, d.source, l.quality = 0 AS actual, d.n_chars < 400 AS by_length, d.text LIKE '%###%' AS by_symbol, d.text LIKE '% | %' AS by_bar
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
CONFUSION = f"""{JUDGED},
m AS (SELECT detector, count(CASE WHEN hit AND actual THEN 1 END) AS tp, count(CASE WHEN hit AND NOT actual THEN 1 END) AS fp,
             count(CASE WHEN NOT hit AND NOT actual THEN 1 END) AS tn, count(CASE WHEN NOT hit AND actual THEN 1 END) AS fn
      FROM (SELECT 'length' AS detector, by_length AS hit, actual FROM j UNION ALL SELECT 'symbol', by_symbol, actual FROM j UNION ALL SELECT 'bar', by_bar, actual FROM j) t GROUP BY detector),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS c FROM m),
s AS (SELECT *, CASE WHEN p + c = 0 THEN 0 ELSE 2 * p * c / (p + c) END AS f FROM r)"""

BOTH = {
    # joins
    "jn_left_outer_history": "SELECT c.c_custkey, c.c_name, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey",
    "jn_lookup_labels": "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "jn_anti_unlabelled": "SELECT d.doc_id FROM documents d LEFT ANTI JOIN labels l ON d.doc_id = l.doc_id",
    "jn_semi_deceptive": "SELECT d.doc_id, d.source FROM documents d LEFT SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 0) l ON d.doc_id = l.doc_id",
    "jn_merge_labels": "SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'new' WHEN l.toxic = 1 THEN 'changed' ELSE 'kept' END AS action, coalesce(l.quality, 1) AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "jn_overlap_split": "SELECT count(l.doc_id) AS overlap, count(*) - count(l.doc_id) AS fresh FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "jn_two_step_semi": "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')",
    "jn_members_inner": "SELECT n.n_name, r.r_name, c.c_custkey FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey WHERE r.r_name = 'ASIA'",
    "jn_composite_key": "SELECT a.l_orderkey, a.l_partkey, a.l_suppkey, count(*) AS n FROM lineitem a LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') p ON a.l_orderkey = p.l_orderkey AND a.l_partkey = p.l_partkey AND a.l_suppkey = p.l_suppkey WHERE p.l_orderkey IS NOT NULL GROUP BY a.l_orderkey, a.l_partkey, a.l_suppkey",
    "jn_positional": "SELECT u.conv_id, u.turn, u.role, a.role AS next_role FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1",
    "jn_baseline": "SELECT b.l_returnflag AS detector, b.v AS baseline, c.v AS current, c.v - b.v AS delta FROM (SELECT l_returnflag, count(*) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_returnflag) b LEFT JOIN (SELECT l_returnflag, count(*) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_returnflag) c ON b.l_returnflag = c.l_returnflag",
    "jn_self_agreement": "SELECT count(*) AS n, count(CASE WHEN a.quality = b.toxic THEN 1 END) AS agree FROM labels a JOIN labels b ON a.doc_id = b.doc_id",
    "jn_theta_in_group": f"WITH {FINDINGS} SELECT a.scan_id, a.line AS old_line, b.line AS new_line FROM f a JOIN f b ON a.scan_id = b.scan_id AND a.pattern = b.pattern AND a.line <> b.line WHERE a.confidence = 'high' AND b.confidence = 'low'",
    "jn_range_anti": f"WITH {FINDINGS} SELECT scan_id, seq FROM (SELECT *, count(CASE WHEN confidence = 'high' THEN 1 END) OVER (PARTITION BY scan_id ORDER BY seq RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM f) t WHERE confidence = 'low' AND near = 0",
    # aggregates
    "ag_by_confidence": f"WITH {FINDINGS} SELECT scan_id, count(*) AS total, count(CASE WHEN confidence = 'high' THEN 1 END) AS high, count(CASE WHEN confidence = 'medium' THEN 1 END) AS medium, count(CASE WHEN confidence = 'low' THEN 1 END) AS low, count(DISTINCT path) AS files FROM f GROUP BY scan_id",
    "ag_file_pattern": f"WITH {FINDINGS} SELECT scan_id, path, pattern, count(*) AS n FROM f GROUP BY scan_id, path, pattern",
    "ag_weighted_penalty": f"WITH {FINDINGS} SELECT scan_id, sum(CASE confidence WHEN 'high' THEN 30 WHEN 'medium' THEN 15 ELSE 5 END) AS penalty, greatest(0, 100 - sum(CASE confidence WHEN 'high' THEN 30 WHEN 'medium' THEN 15 ELSE 5 END)) AS score FROM f GROUP BY scan_id",
    "ag_keep_max": f"WITH {FINDINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, path ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, seq) AS rn, min(seq) OVER (PARTITION BY scan_id, path) AS first_seq FROM f) SELECT scan_id, path, confidence, line, first_seq FROM r WHERE rn = 1",
    "ag_first_by_pattern": f"WITH {FINDINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, pattern ORDER BY seq) AS rn FROM f) SELECT scan_id, pattern, line, seq FROM r WHERE rn = 1",
    "ag_keep_largest_per_url": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE rn = 1",
    "ag_prefer_manual": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey ELSE -o_orderkey END) AS rn FROM orders) SELECT o_custkey, o_orderkey, o_orderpriority FROM r WHERE rn = 1",
    "ag_multiplicity": "SELECT n, count(*) AS groups FROM (SELECT text, count(*) AS n FROM documents GROUP BY text) t GROUP BY n",
    "ag_accuracy": f"WITH {JUDGED} SELECT count(*) AS n, floor(1e3 * count(CASE WHEN (by_symbol OR by_bar) = actual THEN 1 END) / count(*) + 0.5) / 10 AS accuracy_pct FROM j",
    "ag_histogram": "SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN v <= 0 THEN '0' WHEN v <= 20 THEN '20' WHEN v <= 40 THEN '40' WHEN v <= 60 THEN '60' WHEN v <= 80 THEN '80' ELSE '100' END AS bucket FROM (SELECT event_id % 101 AS v FROM events) a) b GROUP BY bucket",
    "ag_frequency": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "ag_pass_rate": f"WITH {JUDGED} SELECT source, count(*) AS total, count(CASE WHEN by_symbol = actual THEN 1 END) AS passed, floor(1e2 * count(CASE WHEN by_symbol = actual THEN 1 END) / count(*) + 0.5) AS accuracy FROM j GROUP BY source",
    "ag_detector_breakdown": f"WITH {FINDINGS} SELECT pattern, confidence, count(*) AS n FROM f GROUP BY pattern, confidence",
    "ag_total": "SELECT o_custkey, count(*) AS total FROM orders GROUP BY o_custkey",
    "ag_max_id": "SELECT max(o_orderkey) AS max_id, max(o_custkey) AS max_cust FROM orders",
    "ag_agreement": f"WITH {JUDGED} SELECT round(CAST(count(CASE WHEN by_symbol = by_bar THEN 1 END) AS DOUBLE) / count(*), 6) AS rate FROM j",
    "ag_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "ag_spread": "SELECT event_type, round(avg(value), 4) AS mean, round(min(value), 4) AS low, round(max(value), 4) AS high, round(stddev_pop(value), 4) AS sd FROM events GROUP BY event_type",
    # windows
    "win_fusion_rank": f"WITH {FINDINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, path, pattern ORDER BY seq) AS rk FROM f) SELECT scan_id, seq, rk, CASE WHEN confidence = 'high' OR rk = 1 THEN 100 WHEN rk <= 5 THEN 50 ELSE 25 END AS percent FROM r",
    "win_swing": "WITH r AS (SELECT user_id, event_id, value, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts)) AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS back FROM events) SELECT user_id, round(max(d), 4) AS swing FROM r WHERE back < 5 GROUP BY user_id",
    "win_24h": "SELECT event_id, least(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '24' HOUR PRECEDING AND CURRENT ROW), 50) AS recent FROM events",
    "win_streak": "WITH g AS (SELECT *, sum(CASE WHEN value >= 70 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM events) SELECT event_id, CASE WHEN value >= 70 THEN 0 ELSE row_number() OVER (PARTITION BY user_id, island ORDER BY ts) - CASE WHEN island > 0 THEN 1 ELSE 0 END END AS streak FROM g",
    "win_ordinal": f"WITH {FINDINGS} SELECT scan_id, path, seq, row_number() OVER (PARTITION BY scan_id, path ORDER BY seq) AS ordinal, dense_rank() OVER (PARTITION BY scan_id ORDER BY path) AS file_no FROM f",
    "win_lookahead": "SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS ahead, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS last_answer FROM conversations",
    "win_islands": f"WITH {FINDINGS}, a AS (SELECT scan_id, seq, seq - row_number() OVER (PARTITION BY scan_id ORDER BY seq) AS island FROM f WHERE confidence <> 'low') SELECT scan_id, island, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM a GROUP BY scan_id, island",
    "win_running_numbers": "SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS user_no, sum(CASE WHEN role <> 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS other_no FROM conversations",
    # order, limit, sets
    "sl_page": "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) t WHERE rn > 5 AND rn <= 10",
    "sl_top_recent": "SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50",
    "sl_top_findings": f"WITH {FINDINGS} SELECT path, count(*) AS n FROM f GROUP BY path ORDER BY n DESC, path LIMIT 10",
    "sl_multi_key": "SELECT o_custkey, sum(CAST(floor(o_totalprice) AS BIGINT)) AS total, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey ORDER BY first_order, total DESC LIMIT 40",
    "sl_best_worst": f"WITH {CONFUSION}, o AS (SELECT detector, row_number() OVER (ORDER BY f DESC, detector) AS best, row_number() OVER (ORDER BY f, detector DESC) AS worst FROM s) SELECT max(CASE WHEN best = 1 THEN detector END) AS best, max(CASE WHEN worst = 1 THEN detector END) AS worst FROM o",
    "sl_top_finding": f"WITH {FINDINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY CASE WHEN confidence = 'high' THEN 0 ELSE 1 END, seq) AS rn FROM f) SELECT scan_id, pattern, confidence, line FROM r WHERE rn = 1",
    "sl_prefix": "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 20",
    "set_union_all": "SELECT doc_id AS id, 'document' AS kind FROM documents UNION ALL SELECT page_id, 'page' FROM pages UNION ALL SELECT item_id, 'item' FROM benchmark",
    "set_union_distinct": "SELECT l_returnflag AS name FROM lineitem UNION SELECT l_linestatus FROM lineitem UNION SELECT o_orderstatus FROM orders",
    "set_not_in_delete": "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)",
    "set_partition": "SELECT CASE WHEN text LIKE '%###%' THEN 'symbols' WHEN text LIKE '% | %' THEN 'bars' ELSE 'rest' END AS part, count(*) AS n FROM documents GROUP BY 1",
    "set_remainder": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "set_distinct_names": "SELECT DISTINCT event_type FROM events WHERE length(event_type) > 2 AND event_type NOT IN ('click') ORDER BY event_type LIMIT 10",
    # scores by other profiles
    "sc_package_profile": f"WITH {FINDINGS}, d AS (SELECT *, row_number() OVER (PARTITION BY scan_id, path, line ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, seq) AS rn FROM f) SELECT scan_id, greatest(0, 100 - sum(CASE confidence WHEN 'high' THEN 30 WHEN 'medium' THEN 15 ELSE 5 END)) AS score FROM d WHERE rn = 1 GROUP BY scan_id",
    "sc_judge_apply": f"WITH {FINDINGS}, v AS (SELECT *, CASE line % 4 WHEN 0 THEN 'FALSE_POSITIVE' WHEN 1 THEN 'CONTEXTUAL' WHEN 2 THEN 'VALID' END AS verdict FROM f) SELECT scan_id, seq, CASE WHEN verdict = 'CONTEXTUAL' THEN CASE confidence WHEN 'high' THEN 'medium' ELSE 'low' END ELSE confidence END AS confidence FROM v WHERE verdict IS NULL OR verdict <> 'FALSE_POSITIVE'",
    "sc_band": "SELECT doc_id, CASE WHEN n_chars % 101 >= 80 THEN 'CLEAN' WHEN n_chars % 101 >= 50 THEN 'SUSPICIOUS' ELSE 'LIKELY_DECEPTIVE' END AS verdict, n_chars % 101 >= 70 AS passed FROM documents",
    # history, ledgers, idempotence
    "st_ledger": "SELECT event_id, 30 + sum(CASE event_type WHEN 'purchase' THEN -3 WHEN 'refund' THEN 3 ELSE -2 END) OVER (PARTITION BY user_id ORDER BY ts) AS balance FROM events",
    "st_idempotent": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) SELECT event_id, user_id, event_type FROM r WHERE rn = 1",
    # upserts and deletes as rewrites
    # evaluation
    "ev_distribute": f"WITH {CONFUSION}, w AS (SELECT detector, CASE WHEN f = 0 THEN 0 ELSE least(15, greatest(0, floor(f * 20 + 0.5))) END AS w FROM s) SELECT detector, floor(w * 6e-1 + 0.5) AS high, floor(w * 3e-1 + 0.5) AS medium, greatest(0, w - floor(w * 6e-1 + 0.5) - floor(w * 3e-1 + 0.5)) AS low FROM w",
    "ev_reliability": f"WITH {CONFUSION}, k AS (SELECT detector, p * least(1e0, least(tp + fn, fp + tn) / 5e1) AS r FROM s) SELECT detector, greatest(2, floor(20 * r + 0.5)) AS high, greatest(1, floor(10 * r + 0.5)) AS medium, greatest(0, floor(3 * r + 0.5)) AS low FROM k",
    "ev_auto_label": "SELECT doc_id, CASE WHEN n_chars % 101 >= 80 THEN 'LEGIT' WHEN n_chars % 101 < 50 THEN 'DECEPTIVE' ELSE 'AMBIGUOUS' END AS label FROM documents",
    "ev_audit": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic",
    "ev_false_positives": f"WITH {JUDGED} SELECT source, CASE WHEN by_symbol THEN 'symbol' WHEN by_bar THEN 'bar' ELSE 'length' END AS reason, count(*) AS n FROM j WHERE NOT actual AND (by_symbol OR by_bar OR by_length) GROUP BY 1, 2",
    "ev_size_stats": "SELECT count(*) AS n, floor(avg(n_chars)) AS mean_chars, max(n_chars) AS max_chars, count(CASE WHEN n_chars > 50000 THEN 1 END) AS over_50k FROM documents",
    "ev_benchmark_run": f"WITH {JUDGED} SELECT count(*) AS total, count(CASE WHEN abs(d) <= 20 THEN 1 END) AS passed, floor(1e2 * count(CASE WHEN abs(d) <= 20 THEN 1 END) / count(*) + 0.5) AS accuracy FROM (SELECT CASE WHEN actual THEN 40 ELSE 100 END - CASE WHEN by_symbol OR by_bar THEN 45 ELSE 95 END AS d FROM j) t",
    # text functions
    "fn_url_parts": "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages",
    "fn_normalise_name": "SELECT page_id, lower(regexp_replace(url, '[^a-zA-Z0-9_-]', '_')) AS name FROM pages",
    "fn_hash": "SELECT doc_id, substr(md5(text), 1, 16) AS short_md5 FROM documents",
    "fn_pad_repeat": "SELECT event_type, rpad(event_type, 12, '.') AS padded, repeat('#', CAST(floor(count(*) / 100) AS INT)) AS bar FROM events GROUP BY event_type",
    "fn_days_until": "SELECT o_orderkey, CAST(ceil((1000 - (o_orderkey % 997)) / 3e1) AS BIGINT) AS periods FROM orders",
    "fn_round": "SELECT l_orderkey, l_linenumber, l_partkey, floor(l_quantity * l_discount + 0.5) AS rounded FROM lineitem",
    "fn_cost": "SELECT source, sum(n_chars) AS chars, round(sum(n_chars) / 4e0 / 1000000 * CASE WHEN source LIKE 'src1%' THEN 13e-2 ELSE 2e-2 END, 6) AS cost FROM documents GROUP BY source",
    "flt_keywords": "SELECT doc_id FROM documents WHERE lower(text) LIKE '%license%' AND length(text) BETWEEN 20 AND 500000",
}

#: The oracle's text where its dialect differs from Spark's.
DUCK = {k: v.replace("LEFT ANTI JOIN", "ANTI JOIN").replace("LEFT SEMI JOIN", "SEMI JOIN") for k, v in BOTH.items()}
DUCK["fn_normalise_name"] = DUCK["fn_normalise_name"].replace("'_')", "'_', 'g')")

PAIRS = {
    "fn_line_explode": (
        "SELECT doc_id, pos, line FROM documents LATERAL VIEW posexplode(split(text, chr(10))) t AS pos, line",
        "SELECT doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS pos, unnest(string_split(text, chr(10))) AS line FROM documents",
    ),
    "fn_regex_count": (
        "SELECT page_id, regexp_count(html, '<p>') AS paragraphs, regexp_count(html, '<a ') AS links FROM pages",
        "SELECT page_id, len(regexp_extract_all(html, '<p>'))::INT AS paragraphs, len(regexp_extract_all(html, '<a '))::INT AS links FROM pages",
    ),
    "fn_json_fields": (
        "SELECT event_id, length(props) AS n, try_parse_json(props) IS NOT NULL AS valid FROM events",
        "SELECT event_id, length(props)::INT AS n, json_valid(props) AS valid FROM events",
    ),
    "fn_base64": (
        "SELECT item_id, decode(unbase64(base64(CAST(text AS BINARY))), 'UTF-8') AS text FROM benchmark",
        "SELECT item_id, decode(from_base64(to_base64(encode(text)))) AS text FROM benchmark",
    ),
    "fn_format_id": ("SELECT doc_id, format_string('gt_%04d', doc_id) AS id FROM documents", "SELECT doc_id, format('gt_{:04d}', doc_id) AS id FROM documents"),
    "fn_dot_calls": (
        r"SELECT name, count(*) AS n FROM (SELECT explode(regexp_extract_all(text, '([a-z]+)\.', 1)) AS name FROM documents) t GROUP BY name ORDER BY n DESC, name LIMIT 30",
        r"SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '([a-z]+)\.', 1)) AS name FROM documents) t GROUP BY name ORDER BY n DESC, name LIMIT 30",
    ),
    "fn_writing_style": (
        r"""WITH w AS (SELECT doc_id, pos, word FROM documents LATERAL VIEW posexplode(filter(split(regexp_replace(lower(text), '[^a-z0-9_ \n]', ''), '[ \n]+'), x -> x <> '')) t AS pos, word),
        c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS p FROM w GROUP BY doc_id, word),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS k FROM c)
        SELECT doc_id, substr(md5(array_join(transform(array_sort(collect_list(struct(k, word, n))), x -> concat(x.word, ':', x.n)), '|')), 1, 16) AS style FROM r WHERE k <= 20 GROUP BY doc_id""",
        r"""WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_ \n]', '', 'g'), '[ \n]+'), lambda x: x <> '') AS ws FROM documents),
        w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM l), c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS p FROM w GROUP BY doc_id, word),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS k FROM c)
        SELECT doc_id, substr(md5(string_agg(word || ':' || n, '|' ORDER BY k)), 1, 16) AS style FROM r WHERE k <= 20 GROUP BY doc_id""",
    ),
    "ag_upper_median": (  # counts per range of values say in which one the median lies; only that one is looked into
        "WITH b AS (SELECT event_type, floor(value) AS bucket, count(*) AS n FROM events GROUP BY event_type, floor(value)), c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY event_type) AS total FROM b), "
        "m AS (SELECT event_type, bucket, floor(total / 2) - (cum - n) AS place FROM c WHERE cum > floor(total / 2) AND cum - n <= floor(total / 2)), v AS (SELECT e.event_type, e.value, count(*) AS n, max(m.place) AS place FROM events e JOIN m ON e.event_type = m.event_type AND floor(e.value) = m.bucket GROUP BY e.event_type, e.value), "
        "r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY value) AS cum FROM v) SELECT event_type, min(CASE WHEN cum > place THEN value END) AS median FROM r GROUP BY event_type",
        "SELECT event_type, list_sort(list(value))[(count(*) // 2 + 1)::INT] AS median FROM events GROUP BY event_type",
    ),
    "ag_ordered_concat": (
        "SELECT conv_id, array_join(transform(array_sort(collect_list(struct(turn, role))), x -> x.role), ', ') AS roles FROM conversations GROUP BY conv_id",
        "SELECT conv_id, string_agg(role, ', ' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id",
    ),
    "ag_nested_detail": (
        f"WITH {FINDINGS}, c AS (SELECT scan_id, confidence, count(*) AS n FROM f GROUP BY scan_id, confidence) SELECT scan_id, array_sort(collect_list(concat(confidence, ':', n))) AS detail FROM c GROUP BY scan_id",
        f"WITH {FINDINGS}, c AS (SELECT scan_id, confidence, count(*) AS n FROM f GROUP BY scan_id, confidence) SELECT scan_id, list_sort(list(confidence || ':' || n)) AS detail FROM c GROUP BY scan_id",
    ),
    "win_ring_buffer": (
        "SELECT event_id, array_join(collect_list(event_type) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), ',') AS last_ten FROM events",
        "SELECT event_id, string_agg(event_type, ',') OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS last_ten FROM events",
    ),
    "win_running_depth": (
        "WITH c AS (SELECT page_id, pos, CASE WHEN t LIKE '</%' THEN -1 ELSE 1 END AS step FROM pages LATERAL VIEW posexplode(regexp_extract_all(html, '</?(?:div|nav|ul|li|article)[ >]', 0)) x AS pos, t) SELECT page_id, pos, sum(step) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM c",
        "WITH t AS (SELECT page_id, regexp_extract_all(html, '</?(?:div|nav|ul|li|article)[ >]') AS ts FROM pages), c AS (SELECT page_id, (generate_subscripts(ts, 1) - 1)::INT AS pos, CASE WHEN unnest(ts) LIKE '</%' THEN -1 ELSE 1 END AS step FROM t) SELECT page_id, pos, sum(step) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM c",
    ),
    "set_array_difference": (
        "WITH a AS (SELECT o_custkey, collect_set(o_orderstatus) AS s, collect_set(o_orderpriority) AS p FROM orders GROUP BY o_custkey) SELECT o_custkey, array_join(array_sort(array_except(array('F', 'O', 'P'), s)), ',') AS missing, size(array_union(s, p)) AS n FROM a",
        "WITH a AS (SELECT o_custkey, list(DISTINCT o_orderstatus) AS s, list(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_custkey) SELECT o_custkey, array_to_string(list_sort(list_filter(['F', 'O', 'P'], lambda x: NOT list_contains(s, x))), ',') AS missing, len(list_distinct(list_concat(s, p)))::INT AS n FROM a",
    ),
    "sl_slice": (
        # three rows of a scan are gathered, not all of them
        f"WITH {FINDINGS}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY seq) AS place FROM f) p WHERE place <= 3) SELECT scan_id, array_join(transform(array_sort(collect_list(struct(seq, line))), x -> x.line), ',') AS first_lines FROM t GROUP BY scan_id",
        f"WITH {FINDINGS} SELECT scan_id, array_to_string((list(line ORDER BY seq))[1:3], ',') AS first_lines FROM f GROUP BY scan_id",
    ),
    "vec_quantise": (
        "SELECT vec_id, transform(embedding, x -> CAST(round(CAST(x AS DOUBLE) * 127 / array_max(transform(embedding, y -> abs(CAST(y AS DOUBLE))))) AS INT)) AS q FROM embeddings",
        "SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 127 / list_max(list_transform(embedding, lambda y: abs(y::DOUBLE))))::INT) AS q FROM embeddings",
    ),
    "vec_symbol_lookup": (
        "SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) t WHERE rn <= 5",
        "SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5",
    ),
    "jn_contamination": (
        """WITH g AS (SELECT DISTINCT doc_id, explode(transform(sequence(1, size(w) - 7), i -> array_join(slice(w, i, 8), ' '))) AS g FROM (SELECT doc_id, split(text, '[ \n]+') AS w FROM documents) d WHERE size(w) >= 8),
        b AS (SELECT DISTINCT item_id, explode(transform(sequence(1, size(w) - 7), i -> array_join(slice(w, i, 8), ' '))) AS g FROM (SELECT item_id, split(text, '[ \n]+') AS w FROM benchmark) d WHERE size(w) >= 8)
        SELECT doc_id, item_id, count(*) AS shared FROM g JOIN b ON g.g = b.g GROUP BY doc_id, item_id""",
        """WITH gd AS (SELECT doc_id, regexp_split_to_array(text, '[ \n]+') AS w FROM documents), bd AS (SELECT item_id, regexp_split_to_array(text, '[ \n]+') AS w FROM benchmark),
        g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 6)) AS i FROM gd WHERE len(w) >= 8)), b AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 6)) AS i FROM bd WHERE len(w) >= 8))
        SELECT doc_id, item_id, count(*) AS shared FROM g JOIN b ON g.g = b.g GROUP BY doc_id, item_id""",
    ),
    "vec_context_budget": (
        "WITH c AS (SELECT conv_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations), b AS (SELECT *, min(CASE WHEN used > 400 THEN turn END) OVER (PARTITION BY conv_id) AS stop FROM c) SELECT conv_id, array_join(transform(array_sort(collect_list(struct(turn, text))), x -> x.text), chr(10)) AS context FROM b WHERE stop IS NULL OR turn < stop GROUP BY conv_id",
        "WITH c AS (SELECT conv_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations), b AS (SELECT *, min(CASE WHEN used > 400 THEN turn END) OVER (PARTITION BY conv_id) AS stop FROM c) SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS context FROM b WHERE stop IS NULL OR turn < stop GROUP BY conv_id",
    ),
    "vec_candidate_symbols": (
        "SELECT s, count(*) AS n FROM (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, explode(regexp_extract_all(text, '([A-Z][a-z]{3,}) ', 1)) AS s FROM documents) a) b GROUP BY s ORDER BY n DESC, s LIMIT 50",
        "SELECT s, count(*) AS n FROM (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Z][a-z]{3,}) ', 1)) AS s FROM documents) a) b GROUP BY s ORDER BY n DESC, s LIMIT 50",
    ),
    "ev_label_queue": (
        f"WITH {FINDINGS}, c AS (SELECT scan_id, pattern, count(*) AS n FROM f GROUP BY scan_id, pattern) SELECT scan_id, array_join(transform(array_sort(collect_list(struct(-n AS m, pattern, n))), x -> concat(x.pattern, ':', x.n)), ' ') AS summary FROM c GROUP BY scan_id",
        f"WITH {FINDINGS}, c AS (SELECT scan_id, pattern, count(*) AS n FROM f GROUP BY scan_id, pattern) SELECT scan_id, string_agg(pattern || ':' || n, ' ' ORDER BY n DESC, pattern) AS summary FROM c GROUP BY scan_id",
    ),
    "snk_json_rows": (
        "SELECT o_orderkey, to_json(named_struct('id', o_orderkey, 'status', o_orderstatus)) AS doc FROM orders",
        "SELECT o_orderkey, to_json({'id': o_orderkey, 'status': o_orderstatus})::VARCHAR AS doc FROM orders",
    ),
    "snk_annotation_batches": (
        f"WITH {FINDINGS} SELECT scan_id, seq, CASE confidence WHEN 'high' THEN 'failure' WHEN 'medium' THEN 'warning' ELSE 'notice' END AS level, CAST(ceil(seq / 50) AS BIGINT) AS batch FROM f",
        f"WITH {FINDINGS} SELECT scan_id, seq, CASE confidence WHEN 'high' THEN 'failure' WHEN 'medium' THEN 'warning' ELSE 'notice' END AS level, ceil(seq / 50)::BIGINT AS batch FROM f",
    ),
}

QUERIES = {k: run_sql(v) for k, v in BOTH.items()} | {k: run_sql(s) for k, (s, _) in PAIRS.items()}
ORACLE_SQL = DUCK | {k: d for k, (_, d) in PAIRS.items()}
