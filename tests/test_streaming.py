"""A stream gives what a batch over the same events gives."""

import datetime

import pandas as pd

from hunkflow.streaming import author_events as A


def events(n):
    start = datetime.datetime(2024, 1, 1)
    return pd.DataFrame([(i, start + datetime.timedelta(seconds=7 * i), i % 3, "view", float(i * 37 % 101)) for i in range(n)], columns=["event_id", "ts", "user_id", "event_type", "value"])


def streamed(spark, tmp_path, build, mode, name):
    data = events(120)
    source = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame(data.iloc[40 * i : 40 * i + 40], A.EVENTS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(A.EVENTS).option("maxFilesPerTrigger", 10).parquet(source)
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted(map(tuple, spark.table(name).collect())), spark.createDataFrame(data, A.EVENTS)


def test_rate_limit(spark, tmp_path):
    got, batch = streamed(spark, tmp_path, A.rate_limited, "append", "limited")
    assert got == sorted(map(tuple, A.rate_limited(batch).collect()))


def test_denied_events_are_not_recorded():
    times, allowed = [], []
    for now in range(0, 100_000_000, 5_000_000):
        times, ok, _ = A.limit_step(times, now, 3, 60)
        allowed.append(ok)
    assert allowed[:4] == [True, True, True, False] and allowed[12] and len(times) <= 3


def test_profiles(spark, tmp_path):
    got, batch = streamed(spark, tmp_path, A.profiles, "update", "profiles")
    assert set(map(tuple, A.profiles(batch).collect())) <= set(got)


def test_windows(spark):
    rows = A.windowed(spark.createDataFrame(events(120), A.EVENTS), "5 minutes").collect()
    assert sum(r.n for r in rows) == 120
    assert sum(r.n for r in A.sessions(spark.createDataFrame(events(120), A.EVENTS)).collect()) == 120


def _fold(rows, zero, step):
    state, out = {}, []
    for key, *values in rows:
        state[key], res = step(state.get(key, zero), *values)
        out.append((key, *values, *res))
    return out, state


def test_folds_over_ranges(spark):
    """Half of all rows are one key's, in many ranges, and states that remember all."""
    import random

    from hunkflow.streaming.ordered import Folds

    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", None, *"abcdefgh"]) if i % 2 else "hot", i, rng.random() * 100) for i in range(3000)]
    step = lambda s, i, v: ((s[0] + 1, float(int((s[1] * s[0] + v) / (s[0] + 1) + 0.5))), (s[0], s[1]))
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(5)
    for conf in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", conf)
        folds = Folds(df, "k", ["i"], ["i", "v"], (0, 0.0), step, 12)
        want, last = _fold(rows, (0, 0.0), step)
        got = [tuple(r) for r in folds.rows(["i", "v"], "n long, mean double").collect()]
        assert sorted(got, key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])
        states = folds.states("n long, mean double").collect()
        assert len(states) == len(last) and {r.k: (r.n, r.mean) for r in states} == last
        if conf == "false":
            assert len(folds.goes_on) >= 4 and folds.cut.groupBy("_part").count().agg({"count": "max"}).first()[0] < 900
        folds.close()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Folds(df.where("false"), "k", ["i"], ["i", "v"], (0, 0.0), step).states("n long, mean double").count() == 0


def test_hot_user_is_split(spark):
    data = events(900)
    data["user_id"] = [0 if i % 2 else i % 7 for i in range(900)]
    df = spark.createDataFrame(data, A.EVENTS)
    times, want = {}, set()
    for r in data.itertuples():
        times[r.user_id], ok, left = A.limit_step(times.get(r.user_id, []), r.ts.value // 1000, 3, 3600)
        want.add((r.user_id, r.event_id, ok, left))
    assert set(map(tuple, A.rate_limited(df, "share").collect())) == want


def test_ledger(spark, tmp_path):
    build = lambda e: A.ledger(e, costs={}, free=20, days=0.005)
    got, batch = streamed(spark, tmp_path, build, "append", "ledger")
    assert got == sorted(map(tuple, build(batch).collect()))
    assert sum(r[4] for r in got) > 2 and {r[2] for r in got} == {True, False}
    # what is too dear is refused, what is cheaper still passes
    state, out = None, []
    for at, cost in [(0, 7), (1, 5), (2, 3), (50, 5), (200, 9)]:
        state, row = A.ledger_step(state, at, cost, 10, 100)
        out.append(row)
    assert out == [(True, 3, False, -7), (False, 3, False, 0), (True, 0, False, -3), (False, 0, False, 0), (True, 1, True, -9)]


def test_leases(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    said = [
        ("a", 0, False, "accepted"), ("a", 60, False, "processing"), ("b", 70, False, "accepted"), ("a", 130, False, "retried"), ("a", 140, True, "completed"), ("a", 150, False, "skipped"), ("c", 155, True, "ignored"),
        ("b", 180, True, "completed"), ("c", 200, False, "accepted"), ("b", 900, False, "skipped"), ("a", 901, True, "ignored"), ("d", 5000, False, "accepted"), ("e", 9000, False, "accepted"),
    ]
    rows = [(d, start + datetime.timedelta(seconds=s), i, done) for i, (d, s, done, _) in enumerate(said)]
    schema = "delivery_id string, ts timestamp, event_id long, done boolean"
    df = spark.createDataFrame(rows, schema)
    want = {(d, i, status) for i, (d, _, _, status) in enumerate(said)}
    assert set(map(tuple, A.leases(df).collect())) == want
    # the same events in a stream, file by file; the last one comes again, too late
    source = str(tmp_path / "in")
    for at in (0, 5, 9, 11, 12):
        spark.createDataFrame(rows[at : {0: 5, 5: 9, 9: 11, 11: 12, 12: 13}[at]], schema).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([("a", start, 99, False)], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = A.leases(stream, late="10 seconds").writeStream.outputMode("append").format("memory").queryName("leases").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = [tuple(r) for r in spark.table("leases").collect()]
    assert {r for r in got if r[1] is not None} == want
    assert {r[0] for r in got if r[2] == "stale"} == {"c", "d"}  # b had completed, a is completed before its timer can go off
