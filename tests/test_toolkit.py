"""Files, keyed tables, evaluation and vectors."""

import hmac

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkflow.functions import digests
from hunkflow.operators import chunks, evaluate, numbering, store, vectors
from hunkflow.sources import files
from hunkflow.streaming import deliveries


def test_jsonl_skips_bad_rows(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"repo": "a/b", "diff_snippet": "x", "labels": ["q"]}\n{bad\n{"repo": "c/d"}\n')
    assert [(r.repo, r.labels) for r in files.read_jsonl(spark, str(path)).collect()] == [("a/b", ["q"])]


def test_csv_round_trip(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("note", T.StringType())])
    files.write_csv(spark.createDataFrame([("1", 'says "hi", twice'), ("2", None)], schema).coalesce(1), str(tmp_path / "c"))
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "c"), schema, 2).collect()] == [("1", 'says "hi", twice'), ("2", "")]


def test_csv_rows_are_judged_by_their_fields(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a,b,c\n1,x,\n2,y\n3,"p, q",z\n4,"only, two"\n5\n')
    schema = T.StructType([T.StructField(c, T.StringType()) for c in "abc"])
    assert [tuple(r) for r in files.read_csv(spark, str(path), schema, 3).collect()] == [("1", "x", ""), ("3", "p, q", "z")]
    assert [r.a for r in files.read_csv(spark, str(path), schema, 2).collect()] == ["1", "2", "3", "4"]


def test_numbers_without_one_task(spark):
    rows = spark.range(1000).selectExpr("(id * 37) % 1000 AS k")
    got = {r.k: r.number for r in numbering.numbered(rows, ["k"], start=5).collect()}
    assert got == {k: k + 5 for k in range(1000)}


def test_hmac(spark):
    rows = spark.createDataFrame([("what do ya want for nothing?",), ("",), ("ü",)], "m string").select("m", digests.hmac_sha256(F.col("m"), b"Jefe").alias("h"))
    assert all(r.h == hmac.new(b"Jefe", r.m.encode(), "sha256").hexdigest() for r in rows.collect())


def test_deliveries_are_verified(spark):
    sign = lambda body: "sha256=" + hmac.new(b"k", body.encode(), "sha256").hexdigest()
    good = '{"action": "opened", "number": 7, "extra": {}}'
    raw = spark.createDataFrame([("a", sign(good), good), ("b", sign("x"), good), ("c", None, good), ("d", sign("{no"), "{no")], deliveries.RAW)
    assert [tuple(r) for r in deliveries.verified(raw, b"k").collect()] == [("a", "opened", 7, None, None)]


def test_index_follows_a_stream(spark, tmp_path):
    schema = "repo string, file string, content string, op string, at long"
    steps = [
        [("r", "a", "1", "added", 1), ("r", "b", "x" * 9000, "added", 2), ("r", "c", "3", "added", 3)],
        [("r", "a", "new", "modified", 4), ("r", "c", None, "removed", 5), ("r", "c", None, "removed", 6)],
        [("r", "a", None, "removed", 7), ("q", "a", "4", "added", 8)],
    ]
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        changes = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        deliveries.keep_index(changes, str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination()
        got = {(r.repo, r.file): len(r.content) for r in deliveries.read_index(spark, str(tmp_path / "index")).collect()}
        assert got == [{("r", "a"): 1, ("r", "b"): 8000, ("r", "c"): 1}, {("r", "a"): 3, ("r", "b"): 8000}, {("r", "b"): 8000, ("q", "a"): 1}][i]


def test_chunks(spark):
    rows = [(1, "a.py", "import x\ndef f():\n    pass\nclass B:\n    pass"), (2, "a.txt", "a\nb"), (3, "a.go", None)]
    got = chunks.by_symbol(spark.createDataFrame(rows, "file_id long, path string, content string")).collect()
    assert sorted((r.file_id, r.chunk, r.symbol, r.line_start, r.line_end) for r in got) == [(1, 0, None, 1, 1), (1, 1, "f", 2, 3), (1, 2, "B", 4, 5), (2, 0, None, 1, 2)]


def test_truncate(spark):
    df = spark.createDataFrame([("aaaa\n@@ bb\n@@ cccccc",), ("short",), ("x" * 40,)], "d string")
    assert [r[0] for r in df.select(files.truncate_at_hunk(F.col("d"), 18)).collect()] == ["aaaa\n@@ bb", "short", "x" * 18]


def test_store(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    pairs = lambda df: sorted(map(tuple, df.collect()))
    assert pairs(store.upsert(table, rows, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert pairs(store.insert_missing(table, rows, ["k"])) == [(1, "a"), (2, "b"), (3, "d")]
    assert pairs(store.update(table, F.col("k") == 1, {"v": F.lit("z")})) == [(1, "z"), (2, "b")]
    assert pairs(store.delete(table, F.col("k") == 1)) == [(2, "b")]
    log = spark.createDataFrame([(1, "added", 1), (1, "removed", 2), (2, "added", 1)], "k int, op string, t int")
    assert pairs(store.latest(log, ["k"], "t")) == [(2, "added", 1)]


def test_metrics_and_gate(spark):
    rows = [(True, True)] * 3 + [(True, False)] + [(False, True)] * 2 + [(False, False)] * 4
    counts = evaluate.confusion(spark.createDataFrame(rows, "d boolean, actual boolean"), ["d"])
    row = evaluate.metrics(counts).first()
    assert (row.tp, row.fp, row.tn, row.fn, row.precision, row.recall, row.f1) == (3, 1, 4, 2, 75.0, 60.0, 66.7)
    worse = evaluate.metrics(counts).withColumn("recall", F.lit(50.0))
    assert evaluate.gate(evaluate.metrics(counts), worse).first().failed and not evaluate.gate(worse, evaluate.metrics(counts)).first().failed


def test_split_keeps_groups_whole(spark):
    first = [round(x, 6) for x, _ in zip(evaluate.mulberry32(42), range(3))]
    assert first == [0.601104, 0.448291, 0.852466]
    rows = spark.range(100).withColumn("repo", F.concat(F.lit("r"), (F.col("id") % 10).cast("string")))
    parts = evaluate.holdout_split(rows).groupBy("repo").agg(F.count_distinct("part").alias("n"), F.first("part").alias("p")).collect()
    assert all(r.n == 1 for r in parts) and sum(r.p == "train" for r in parts) == 7


def test_codes(spark):
    data = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id", "embedding AS v")
    codes, scale = vectors.quantise(F.col("v"))
    worst = data.select(F.aggregate(F.zip_with("v", F.transform(codes, lambda c: c * scale), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: F.greatest(s, x)).alias("e"), (scale / 2).alias("h")).agg(F.max(F.col("e") - F.col("h"))).first()[0]
    assert worst < 1e-6


def test_behaviour_counts_a_day_in_rounded_seconds(spark):
    import duckdb

    from hunkflow.operators import behaviour
    from hunkflow.plans import toolkit

    at = ["1970-01-02 00:00:00.4", *(f"1970-01-02 0{n}:30:00.0" for n in range(5, 9)), "1970-01-03 00:00:00.6"]
    rows = [(n, 1, t, 80.0, "a") for n, t in enumerate(at)]
    events = spark.createDataFrame(rows, "event_id long, author long, ts string, score double, style string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r.event_id, r.frequency_anomaly) for r in behaviour.flags(events).collect())
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    c.execute("create table events as select * from (values " + ", ".join(f"({n}, 1, timestamp '{t}', 80.0::double, 'a')" for n, _, t, _, _ in rows) + ") e(event_id, user_id, ts, value, event_type)")
    assert got == sorted(c.execute(f"select event_id, frequency_anomaly from ({toolkit.ORACLE_SQL['st_behaviour']})").fetchall())
    assert got[-1] == (5, 0)
