"""Commits of several tables, their failures, and the index on top of them."""

import pytest
from pyspark.sql import functions as F

from hunkflow.sources.commits import Store, save_scans
from hunkflow.streaming import deliveries

CHANGES = "repo string, file string, content string, op string, at long"


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_parents_and_children(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    scans = spark.createDataFrame([(1, "a"), (2, "b")], "scan_id long, title string")
    findings = spark.createDataFrame([(1, "x"), (1, "y")], "scan_id long, kind string")
    assert store.read("scans") is None and save_scans(store, scans, findings, ("w", 0)) == 1
    joined = store.read("findings").join(store.read("scans"), F.col("scan_ref") == F.col("id"))
    assert sorted(r.kind for r in joined.collect()) == ["x", "y"]
    # the same batch again changes nothing, the next one gets keys of its own
    assert save_scans(store, scans, findings, ("w", 0)) is None and store.read("scans").count() == 2
    assert save_scans(store, scans, findings, ("w", 1)) == 2 and store.read("scans").select("id").distinct().count() == 4
    with pytest.raises(ValueError):
        save_scans(store, scans.where("scan_id = 2"), findings)


def test_failed_child_leaves_no_parent(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.commit({"a": spark.range(3)})
    broken = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        store.commit({"a": spark.range(5), "b": broken})
    assert store.manifest()["version"] == 1 and store.read("a").count() == 3 and store.read("b") is None
    assert store.clean() >= 1 and store.read("a").count() == 3


def test_two_writers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.commit({"a": spark.range(1)})
    late, publish = Store(spark, store.path), store._publish

    def between(manifest):
        late._publish = publish
        store.commit({"a": spark.range(2)})  # takes the number first
        return publish(manifest)

    late._publish = between
    assert late.commit({"b": spark.range(4)}) == 3
    assert store.read("a").count() == 3 and store.read("b").count() == 4


def test_index_merges_on_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(deliveries, "MOST_DELTAS", 3)
    path, want = str(tmp_path / "index"), {}
    for n in range(9):
        rows = [("r", f"f{i}", f"{n}.{i}", "removed" if (n + i) % 4 == 0 else "added", n) for i in range(n % 3, 6, 2)] + [("r", None, "null", "added", 1)] * (n == 5)
        for _ in range(2):  # each batch comes twice
            deliveries.apply_changes(spark.createDataFrame(rows, CHANGES), path, ("s", n))
        for r, f, c, op, _ in rows:
            want.pop((r, f), None)
            if op != "removed":
                want[r, f] = c
        assert {(r.repo, r.file): r.content for r in deliveries.read_index(spark, path).collect()} == want
        assert len(Store(spark, path).manifest()["tables"]["index"]) <= 3
    # an empty batch is a commit like any other
    deliveries.apply_changes(spark.createDataFrame([], CHANGES), path, ("s", 9))
    assert deliveries.read_index(spark, path).count() == len(want)


def test_whole_contents(spark, tmp_path):
    rows = spark.createDataFrame([("r", "f", "x" * 9000, "added", 1)], CHANGES)
    deliveries.apply_changes(rows, str(tmp_path / "cut"))
    deliveries.apply_changes(rows, str(tmp_path / "whole"), most_content=None)
    assert [len(deliveries.read_index(spark, str(tmp_path / p)).first().content) for p in ("cut", "whole")] == [8000, 9000]


def test_compaction_keeps_what_comes_in_meanwhile(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    row = lambda f, c: spark.createDataFrame([("r", f, c, "added", 1)], CHANGES)
    deliveries.apply_changes(row("a", "1"), path)
    deliveries.apply_changes(row("b", "1"), path)
    store = Store(spark, path)
    write = store.write
    monkeypatch.setattr(store, "write", lambda *a: (deliveries.apply_changes(row("a", "2"), path), write(*a))[1])
    deliveries.compact(store)
    assert _rows(deliveries.read_index(spark, path)) == [("r", "a", "2"), ("r", "b", "1")] and len(store.manifest()["tables"]["index"]) == 2
