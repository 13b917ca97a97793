"""Queries that apply the library's tools: keyed tables, vectors, evaluation,
numbering, path classes and author flags; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rules as R
from ..functions import text as T
from ..functions.digests import hashed_words, hmac_sha256
from ..operators import behaviour, chunks, detectors, documents, evaluate, paths, scoring, store, vector_index, vectors
from ..operators.bodies import trivial_bodies
from ..operators.numbering import numbered
from ..sources import change_sets, diffs
from ..sources.tables import shared_path, stored
from ..streaming import author_events as A
from . import relational, scan


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark, sf_dir):
    return diffs.parse_lines(change_sets.change_sets(spark, sf_dir))


# ---- evaluation ----------------------------------------------------------

DETECTED = ["length", "symbol", "bar"]


def _judged(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id")
    rules = {"length": F.col("n_chars") < 400, "symbol": F.col("text").contains("###"), "bar": F.col("text").contains(" | ")}
    return docs.select("doc_id", "source", "lang", (F.col("quality") == 0).alias("actual"), *(c.alias(n) for n, c in rules.items()))


def _measured(rows):
    return evaluate.metrics(evaluate.confusion(rows, DETECTED))


def ag_confusion(spark, sf_dir):
    return evaluate.confusion(_judged(spark, sf_dir), DETECTED)


def ag_precision_recall(spark, sf_dir):
    return _measured(_judged(spark, sf_dir)).select("detector", *(F.col(c).alias(f"{c}_pct") for c in ("precision", "recall", "f1")))


def ev_suggested_weight(spark, sf_dir):
    return _measured(_judged(spark, sf_dir)).select("detector", evaluate.suggested_weight(F.col("f1") / 100).alias("weight"))


def ev_regression_gate(spark, sf_dir):
    rows = _judged(spark, sf_dir)
    gated = evaluate.gate(_measured(rows.where("lang = 'en'")), _measured(rows.where("lang <> 'en'")))
    return gated.select("detector", "precision", "recall", "old_precision", "old_recall", "failed")


def ev_delta(spark, sf_dir):
    rows = _judged(spark, sf_dir)
    return evaluate.delta(_measured(rows.where("lang = 'en'")), _measured(rows))


def ev_holdout_by_source(spark, sf_dir):
    split = evaluate.holdout_split(_judged(spark, sf_dir), "source")
    right = F.count_if((F.col("symbol") | F.col("bar")) == F.col("actual")) / F.count("*")
    return split.groupBy("part").agg(F.count("*").alias("n"), evaluate.percent(right).alias("accuracy"))


def sl_sample(spark, sf_dir):
    return evaluate.sample(_read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality")


def _confusion_sql(where: str = "") -> str:
    """The measures p, c and f (shares) and their percentages per detector."""
    judged = relational.JUDGED.replace("d.doc_id, d.source", "d.doc_id, d.source, d.lang").replace("ON d.doc_id = l.doc_id)", f"ON d.doc_id = l.doc_id {where})")
    pct = lambda x: f"floor({x} * 1000 + 0.5) / 10"
    return f"WITH {relational.CONFUSION.replace(relational.JUDGED, judged)} SELECT detector, tp, fp, tn, fn, {pct('p')} AS pp, {pct('c')} AS rp, {pct('f')} AS fp1 FROM s"


# ---- keyed tables --------------------------------------------------------


def dml_upsert(spark, sf_dir):
    german = _read(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id", F.lit(9).alias("quality"))
    return store.upsert(_read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")), german, ["doc_id"])


def dml_insert_missing(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("quality"))
    return store.insert_missing(_read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")), rows, ["doc_id"])


def dml_update_case(spark, sf_dir):
    return store.update(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_orderstatus") == "O", {"o_totalprice": F.col("o_totalprice") - 10}).drop("o_orderstatus")


def dml_delete_where(spark, sf_dir):
    return store.delete(_read(spark, sf_dir, "events"), F.expr("value < 20 AND event_type = 'click'")).select("event_id", "user_id")


def dml_overwrite_labels(spark, sf_dir):
    labels = _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    marked = _read(spark, sf_dir, "documents").where("text LIKE '%###%'").select("doc_id", F.lit(0).alias("quality")).join(labels.select("doc_id"), "doc_id", "left_semi")
    return store.upsert(labels, marked, ["doc_id"])


def st_latest_op(spark, sf_dir):
    changes = _read(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("op"), "event_id")
    return store.latest(changes, ["user_id"], "at", "op", "click").select("user_id", F.col("op").alias("state"), "event_id")


# ---- vectors -------------------------------------------------------------


def _vectors(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"), "label")
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("v").alias("qv"), F.col("label").alias("q_label")), rows


def vec_cosine_topk(spark, sf_dir):
    queries, rows = _vectors(spark, sf_dir)
    best = vector_index.exact_top_k(queries, rows, 5, F.col("q_label"), F.col("label"), others=True)
    return best.select("q_id", "vec_id", F.round("score", 6).alias("score"))


def vec_index_search(spark, sf_dir):
    """An index of all rows, searched for every row whose id is divisible by 20."""
    queries, rows = _vectors(spark, sf_dir)
    path = shared_path(spark)
    vector_index.build(rows.select("vec_id", "v"), path)
    return vector_index.search(spark, path, queries, 5, others=True).select("q_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def vec_quantise(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select("vec_id", F.transform(vectors.quantise(F.col("embedding"))[0], lambda x: x.cast("int")).alias("q"))


# ---- numbers over a whole table ------------------------------------------


def win_batches(spark, sf_dir):
    return numbered(_read(spark, sf_dir, "embeddings").select("vec_id"), ["vec_id"]).select("vec_id", F.floor(F.col("number") / 20).alias("batch"))


def win_assign_ids(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
    return numbered(rows, ["o_orderkey"], "new_id", 100_001)


def ev_label_import(spark, sf_dir):
    labels = _read(spark, sf_dir, "labels")
    most = labels.agg(F.max("doc_id")).first()[0] or 0
    new = _read(spark, sf_dir, "documents").where("lang IN ('en', 'de')").select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti")
    return numbered(new, ["doc_id"], "new_id", most + 1)


# ---- paths, findings, authors --------------------------------------------

SAMPLE_PATHS = [
    "src/a.ts", "src/a.test.ts", "a/node_modules/b.js", "x/dist/y.js", ".env", "app/.env", "CLAUDE.md", ".cursorrules", ".cursor/rules/a.mdc", ".github/workflows/ci.yml", ".npmrc", "docs/a.md", "lib/a_test.go", "spec/a_spec.rb",
    "CartTest.java", "src/tests/x.py", "package.json", "pom.xml", ".gitignore", "sub/.gitignore", "Makefile", "a.zig", "img/logo.svg", "tsconfig.json", ".claude/skills/x.ts", "x/.vscode/settings.json", "tmp/a", "a/tmp/b", ".npm-init", "k.kts",
]


def flt_path_class(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, SAMPLE_PATHS)), (F.col("o_orderkey") % len(SAMPLE_PATHS)).cast("int") + 1)
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"))
    return rows.select("o_orderkey", "path", paths.path_class(F.col("path")).alias("class"), paths.not_functional(F.col("path")).alias("not_functional"), paths.is_source(F.col("path")).alias("is_source"))


def flt_rebrand(spark, sf_dir):
    return paths.rebrands(_lines(spark, sf_dir))


def flt_safe_depth(spark, sf_dir):
    n = (F.col("l_partkey") % 30).cast("int")
    body = F.concat(F.repeat(F.lit("f("), n), F.lit("x"), F.repeat(F.lit(")"), n), F.repeat(F.lit("g()"), F.col("l_linenumber").cast("int")))
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", body.alias("body")).select("l_orderkey", "l_linenumber", "l_partkey", detectors._safe(F.col("body")).alias("safe"))


def jn_findings_files(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    # the files' counts and what the detector needs come from one pass
    files = detectors.matcher_lines(lines).select("scan_id", "path", "marker", "lang", "suspect").groupBy("scan_id", "path").agg(F.count_if(F.col("marker") == "+").alias("added"), F.min("lang").alias("lang"), F.collect_list("suspect").alias("seen"))
    files = stored(files.where("size(seen) > 0"))
    found = detectors.invented_matchers(lines, files.select(F.inline("seen"))).select("scan_id", "path", "file_idx", "hunk_idx", "line_start", "kind")
    return found.join(files.drop("seen"), ["scan_id", "path"], "left")


def ag_by_language(spark, sf_dir):
    found = trivial_bodies(_lines(spark, sf_dir))
    return found.groupBy(T.language(F.col("path")).alias("lang"), "kind").agg(F.count("*").alias("n"), F.count_distinct("scan_id").alias("scans"))


def sc_package_profile(spark, sf_dir):
    found = relational.run_sql(f"WITH {relational.FINDINGS} SELECT scan_id, path, line AS line_start, pattern AS pattern_type, confidence, CAST(NULL AS STRING) AS importance, pattern AS kind, seq FROM f")(spark, sf_dir)
    penalties = scoring.fused(scoring.dedup(found), "package", fusion=False)
    return penalties.groupBy("scan_id").agg(F.greatest(F.lit(0), 100 - F.sum("penalty")).cast("long").alias("score"))


def sc_async_rescore(spark, sf_dir):
    """Scores of one detector's findings after verdicts (here by their line),
    without their files' importance, as after a judge has answered."""
    scans = change_sets.change_sets(spark, sf_dir)
    lines = diffs.parse_lines(scans)
    # a hunk's first line stands for its file; the detector's few lines come from the same pass
    few = detectors.matcher_lines(lines).select("scan_id", "file_idx", "line_idx", "suspect").where("line_idx = 0 OR suspect IS NOT NULL")
    files = stored(few.groupBy("scan_id").agg(F.size(F.collect_set("file_idx")).cast("long").alias("files_scanned"), F.collect_list("suspect").alias("seen")))
    found = detectors.invented_matchers(lines, files.select(F.inline("seen"))).withColumn("seq", F.row_number().over(W.partitionBy("scan_id").orderBy(*detectors.ORDER)))
    verdict = F.when(F.col("line_start") % 4 == 0, "FALSE_POSITIVE").when(F.col("line_start") % 4 == 1, "CONTEXTUAL")
    judged = scoring.apply_verdicts(found, verdict).withColumn("importance", F.lit(None).cast("string"))
    return scoring.scores(judged, scans, files.drop("seen"), deduplicate=False).select("scan_id", "findings", "penalty", "trust_score", "verdict")


def st_behaviour(spark, sf_dir):
    scans = _read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("author"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("score"), F.col("event_type").alias("style"))
    return behaviour.flags(scans)


def st_sliding_windows(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    return A.windowed(events, "1 hour", "30 minutes").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def fn_hmac(spark, sf_dir):
    return _read(spark, sf_dir, "benchmark").select("item_id", hmac_sha256(F.col("text"), SECRET).alias("signature"))


def vec_embed(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", hashed_words(F.col("text"), 16).alias("v"))


def vec_chunks(spark, sf_dir):
    """The derived change sets' added lines, as files."""
    added = _lines(spark, sf_dir).where("marker = '+'")
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk_idx", "line_idx", "body"))), lambda x: x["body"]), "\n")
    files = added.groupBy("scan_id", "file_idx", "path").agg(content.alias("content"))
    return chunks.by_symbol(files.select((F.col("scan_id") * 100 + F.col("file_idx")).alias("file_id"), "path", "content"))


def jn_contamination(spark, sf_dir):
    return documents.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def fn_writing_style(spark, sf_dir):
    return documents.writing_style(_read(spark, sf_dir, "documents"))


SECRET = b"not a secret"
NAMES = (
    "ag_confusion ag_precision_recall ev_suggested_weight ev_regression_gate ev_delta ev_holdout_by_source sl_sample dml_upsert dml_insert_missing dml_update_case dml_delete_where dml_overwrite_labels st_latest_op "
    "vec_cosine_topk vec_index_search vec_quantise win_batches win_assign_ids ev_label_import flt_path_class flt_rebrand flt_safe_depth jn_findings_files ag_by_language sc_package_profile sc_async_rescore st_behaviour st_sliding_windows fn_hmac vec_embed vec_chunks jn_contamination fn_writing_style"
).split()
QUERIES = {n: globals()[n] for n in NAMES}

_PATHS = "[" + ", ".join(map(change_sets.quote, SAMPLE_PATHS)) + "]"
_ARTIFACT = f"({diffs.rx('path', R.AGENT_ROOT_FILES)} OR {diffs.rx('path', R.IGNORED_PATHS)} OR len(list_filter(string_split(path, '/'), lambda p: starts_with(p, '.') AND p NOT IN ({', '.join(map(change_sets.quote, R.INFRA_DOT_DIRS))}))) > 0)"
_ROOT = f"(NOT contains(path, '/') AND {diffs.rx('path', R.ROOT_CONFIG_FILES)})"
_KEEP = {n: relational.ORACLE_SQL[n] for n in ("vec_quantise", "sc_package_profile") if n in relational.ORACLE_SQL}
_PADS = ["".join(f"\\x{b ^ pad:02X}" for b in SECRET.ljust(64, b"\0")) for pad in (0x36, 0x5C)]
_OPENS = diffs.by_lang(R.SYMBOL_START, lambda p: diffs.rx("line", p))
ORACLE_SQL = {
    "fn_hmac": f"SELECT item_id, sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(text)))) AS signature FROM benchmark",
    "vec_embed": """WITH b AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 16) AS b FROM documents)
      SELECT doc_id, list_transform(range(0, 16), lambda k: len(list_filter(b, lambda x: x = k))::INT) AS v FROM b""",
    "vec_chunks": f"""WITH {scan._BASE}, a AS (SELECT scan_id * 100 + file_idx AS file_id, path, lang, body AS line, row_number() OVER (PARTITION BY scan_id, file_idx ORDER BY hunk_idx, line_idx) - 1 AS pos FROM x WHERE marker = '+'),
      o AS (SELECT *, coalesce({_OPENS}, false) AS opens FROM a), c AS (SELECT *, sum(opens::INT) OVER (PARTITION BY file_id ORDER BY pos) AS chunk FROM o)
      SELECT file_id, path, chunk::INT AS chunk, max(CASE WHEN opens THEN regexp_extract(line, '{R.SYMBOL_NAME}', 1) END) AS symbol, (min(pos) + 1)::INT AS line_start, (max(pos) + 1)::INT AS line_end, string_agg(line, chr(10) ORDER BY pos) AS content FROM c GROUP BY file_id, path, chunk""",
    "ag_confusion": f"SELECT detector, tp, fp, tn, fn FROM ({_confusion_sql()})",
    "ag_precision_recall": f"SELECT detector, pp AS precision_pct, rp AS recall_pct, fp1 AS f1_pct FROM ({_confusion_sql()})",
    "ev_suggested_weight": f"SELECT detector, CASE WHEN fp1 = 0 THEN 0 ELSE least(15, greatest(0, floor(fp1 / 100 * 20 + 0.5))) END::BIGINT AS weight FROM ({_confusion_sql()})",
    "ev_regression_gate": f"SELECT n.detector, n.pp AS precision, n.rp AS recall, o.pp AS old_precision, o.rp AS old_recall, o.pp - n.pp > 5 OR o.rp - n.rp > 5 AS failed FROM ({_confusion_sql("AND lang <> 'en'")}) n LEFT JOIN ({_confusion_sql("AND lang = 'en'")}) o USING (detector)",
    "ev_delta": f"SELECT n.detector, round(n.pp - o.pp, 1) AS precision_delta, round(n.rp - o.rp, 1) AS recall_delta, round(n.fp1 - o.fp1, 1) AS f1_delta FROM ({_confusion_sql()}) n JOIN ({_confusion_sql("AND lang = 'en'")}) o USING (detector)",
    # the generator's numbers and the swaps of the shuffle, one step a row
    "ev_holdout_by_source": f"""WITH RECURSIVE {relational.JUDGED}, g AS (SELECT list(DISTINCT source ORDER BY source) AS l FROM j),
      r(i, a, l) AS (SELECT len(l) - 1, 42::BIGINT, l FROM g UNION ALL
        SELECT i - 1, b, list_transform(l, lambda x, p: CASE p - 1 WHEN i THEN l[k + 1] WHEN k THEN l[i + 1] ELSE x END) FROM (
          SELECT i, l, b, floor(xor(u, u >> 14) / 4294967296.0::DOUBLE * (i + 1))::BIGINT AS k FROM (
            SELECT i, l, b, xor(t, ((t::HUGEINT + (xor(t, t >> 7)::HUGEINT * (t | 61)) % 4294967296) % 4294967296)::BIGINT) AS u FROM (
              SELECT i, l, b, ((xor(b, b >> 15)::HUGEINT * (b | 1)) % 4294967296)::BIGINT AS t FROM (SELECT i, l, (a + 1831565813) % 4294967296 AS b FROM r WHERE i > 0))))),
      c AS (SELECT l[1:ceil(0.7 * len(l))::INT] AS chosen FROM r WHERE i = 0)
      SELECT CASE WHEN list_contains(chosen, source) THEN 'train' ELSE 'holdout' END AS part, count(*) AS n, floor(1000 * count(*) FILTER ((by_symbol OR by_bar) = actual)::DOUBLE / count(*) + 0.5) / 10 AS accuracy FROM j, c GROUP BY 1""",
    "sl_sample": "SELECT doc_id, quality FROM labels QUALIFY row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) <= greatest(1, ceil(0.1::DOUBLE * count(*) OVER ()))",
    "dml_upsert": "SELECT doc_id, quality::INT AS quality FROM labels ANTI JOIN (SELECT doc_id FROM documents WHERE lang = 'de') d USING (doc_id) UNION ALL SELECT doc_id, 9 FROM documents WHERE lang = 'de'",
    "dml_insert_missing": "SELECT doc_id, quality::INT AS quality FROM labels UNION ALL SELECT DISTINCT d.doc_id, 1 FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id",
    "dml_update_case": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice - 10 ELSE o_totalprice END AS o_totalprice FROM orders",
    "dml_delete_where": "SELECT event_id, user_id FROM events WHERE NOT (value < 20 AND event_type = 'click')",
    "dml_overwrite_labels": "SELECT l.doc_id, coalesce(m.q, l.quality)::INT AS quality FROM labels l LEFT JOIN (SELECT doc_id, 0 AS q FROM documents WHERE text LIKE '%###%') m ON l.doc_id = m.doc_id",
    "st_latest_op": "SELECT user_id, event_type AS state, event_id FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'click'",
    "vec_cosine_topk": """SELECT q_id, vec_id, round(score, 6) AS score FROM (SELECT q.vec_id AS q_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score
      FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0) QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) <= 5""",
    "win_batches": "SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 20 AS batch FROM embeddings",
    "win_assign_ids": "SELECT o_orderkey, 100000 + row_number() OVER (ORDER BY o_orderkey) AS new_id FROM orders WHERE o_orderstatus = 'O'",
    "ev_label_import": "SELECT d.doc_id, (SELECT max(doc_id) FROM labels) + row_number() OVER (ORDER BY d.doc_id) AS new_id FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang IN ('en', 'de')",
    "flt_path_class": f"""SELECT o_orderkey, path, CASE WHEN {_ARTIFACT} THEN 'artifact' WHEN {diffs.rx('path', R.WIDE_TEST_FILE)} THEN 'test' WHEN {diffs.rx('path', R.WIDE_SOURCE_FILE)} THEN 'source'
      WHEN {diffs.rx('path', R.WIDE_CONFIG_FILE)} OR {_ROOT} THEN 'config' ELSE 'docs' END AS class, CASE WHEN {_ARTIFACT} THEN true WHEN {_ROOT} THEN false ELSE {diffs.rx('path', R.WIDE_DOCS_FILE)} END AS not_functional,
      regexp_matches(lower(path), '\\.({'|'.join(e[1:] for x in R.EXTENSIONS.values() for e in x)})$') AS is_source FROM (SELECT o_orderkey, ({_PATHS})[(o_orderkey % {len(SAMPLE_PATHS)})::INT + 1] AS path FROM orders)""",
    "flt_rebrand": f"""WITH {change_sets.SQL}, {diffs.LINES_SQL}, n AS (SELECT *, regexp_extract(body, '"name":\\s*"(.+?)"', 1) AS name FROM lines WHERE regexp_matches(path, '(?i)package\\.json$')),
      h AS (SELECT scan_id, arg_max(name, line_idx) FILTER (marker = '-' AND name <> '') AS o, arg_max(name, line_idx) FILTER (marker = '+' AND name <> '') AS w FROM n GROUP BY scan_id, file_idx, hunk_idx)
      SELECT scan_id, coalesce(bool_or(o <> w), false) AS rebrand FROM (SELECT DISTINCT scan_id FROM lines) LEFT JOIN h USING (scan_id) GROUP BY scan_id""",
    "flt_safe_depth": "SELECT l_orderkey, l_linenumber, l_partkey, 3 * (l_partkey % 30) + 1 + 3 * l_linenumber <= 500 AND (l_partkey % 30 + l_linenumber <= 20 OR greatest(l_partkey % 30, 1) <= 20) AS safe FROM lineitem",
    "jn_findings_files": f"WITH {scan._BASE}, {scan.D6_SQL}, fc AS (SELECT scan_id, path, count(*) FILTER (marker = '+') AS added, min(lang) AS lang FROM x GROUP BY ALL) SELECT d6.scan_id, d6.path, file_idx, hunk_idx, line_start, kind, added, lang FROM d6 LEFT JOIN fc USING (scan_id, path)",
    "ag_by_language": f"WITH {scan._BASE}, {scan.D7B_SQL}, p AS (SELECT DISTINCT path, lang FROM files) SELECT lang, kind, count(*) AS n, count(DISTINCT scan_id) AS scans FROM d7b JOIN p USING (path) GROUP BY ALL",
    **{n: relational.PAIRS[n][1] for n in ("jn_contamination", "fn_writing_style")},
    "sc_package_profile": relational.DUCK["sc_package_profile"],
    "vec_quantise": relational.PAIRS["vec_quantise"][1],
    "sc_async_rescore": f"""WITH {scan._BASE}, {scan.D6_SQL}, f0 AS (SELECT *, 'hallucinated_assertion' AS pattern_type, row_number() OVER (PARTITION BY scan_id ORDER BY file_idx, hunk_idx, phase, i1, i2) AS seq FROM d6),
      found AS (SELECT * REPLACE (CASE WHEN line_start % 4 = 1 THEN CASE confidence WHEN 'high' THEN 'medium' ELSE 'low' END ELSE confidence END AS confidence, NULL::VARCHAR AS importance) FROM f0 WHERE line_start % 4 <> 0),
      dd AS (SELECT * EXCLUDE (seq), seq AS first_seq FROM found), {scan.SCORE_SQL[scan.SCORE_SQL.index('rk AS'):]} SELECT scan_id, findings, penalty, trust_score, verdict FROM j3""",
    "st_sliding_windows": "SELECT event_type, time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS start, count(*) AS n FROM events, range(0, 2) r(k) GROUP BY ALL",
    "st_behaviour": f"""WITH a AS (SELECT *, row_number() OVER o AS scans, abs(value - lag(value) OVER o) AS swing, sum((value >= 70)::INT) OVER o AS passes, list(event_type) OVER (o ROWS BETWEEN {behaviour.KEPT_STYLES} PRECEDING AND 1 PRECEDING) AS styles,
        least(count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), 50) AS recent FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
      b AS (SELECT *, max(swing) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS worst, CASE WHEN value < 70 THEN sum((value < 70)::INT) OVER (PARTITION BY user_id, passes ORDER BY ts, event_id) ELSE 0 END AS failures FROM a),
      c AS (SELECT event_id, CASE WHEN len(styles) >= 2 AND len(list_filter(styles, lambda h: h = event_type)) / len(styles) < 1 - 0.7::DOUBLE THEN -3 ELSE 0 END AS style_change, CASE WHEN scans > 3 AND hour(ts) >= 1 AND hour(ts) < 5 THEN -3 ELSE 0 END AS odd_hours,
        CASE WHEN worst >= 40 THEN -8 WHEN worst >= 20 THEN -3 ELSE 0 END AS score_volatility, CASE WHEN scans = 1 THEN -3 ELSE 0 END AS new_author, CASE WHEN scans > 3 AND recent > 10 THEN -5 WHEN scans > 3 AND recent > 5 THEN -2 ELSE 0 END AS frequency_anomaly,
        CASE WHEN failures >= 3 THEN -least(3 * failures, 12) ELSE 0 END::INT AS consecutive_failures FROM b)
      SELECT *, style_change + odd_hours + score_volatility + new_author + frequency_anomaly + consecutive_failures AS modifier FROM c""",
}
