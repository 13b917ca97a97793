"""The vector index against brute force."""

import numpy as np
import pytest

from hunkflow.operators import vector_index as V
from hunkflow.plans.toolkit import QUERIES

SF = "/root/testdata/sf0.01"


def _brute(ids, v, queries, k, others=True, keys=None):
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    out = {}
    for i in queries:
        row = np.round(unit[ids == i] @ unit.T, 9)[0]
        row[(ids == i) if others else np.zeros(len(ids), bool)] = -9
        if keys is not None:
            row[keys != keys[ids == i][0]] = -9
        best = np.lexsort((ids, -row))[:k]
        out[int(i)] = [(int(ids[b]), float(row[b])) for b in best]
    return out


def _recall(found, want):
    """Rows found that are no worse than the worst of the best; equal scores count alike."""
    hits = sum(min(len(w), sum(score >= w[-1][1] - 1e-6 for _, score in found.get(q, []))) for q, w in want.items())
    return hits / sum(map(len, want.values()))


def _by_query(rows):
    out = {}
    for r in rows:
        out.setdefault(r.q_id, []).append((r.vec_id, r.score))
    return out


def test_query_finds_the_neighbours(spark):
    data = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, v = data.vec_id.to_numpy(), np.stack(data.embedding).astype(float)
    want = _brute(ids, v, ids[ids % 20 == 0], 5)
    found = _by_query(QUERIES["vec_index_search"](spark, SF).collect())
    assert set(found) == set(want) and _recall(found, want) >= 0.9
    assert all(i != q and len(rows) == len({i for i, _ in rows}) == 5 for q, rows in found.items() for i, _ in rows)


@pytest.fixture(scope="module")
def crowded(spark):
    """A third of all rows are one vector, some are zero, one is null."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 24)) + 4 * rng.normal(size=(30, 24))[rng.integers(0, 30, 3000)]
    v[::3] = v[0]
    v[1:40:13] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)]
    return v, spark.createDataFrame(rows, "vec_id long, v array<float>").repartition(5)


def test_index_holds_every_row_once(spark, crowded, tmp_path, monkeypatch):
    v, rows = crowded
    path = str(tmp_path / "index")
    q = V.fit(rows, 20, 500)
    V.build(rows, path, q)
    lists, exact, back, needed = V.read(spark, path)
    assert sorted(r.vec_id for r in lists.collect()) == list(range(3000)) and exact.count() == 3000
    assert np.allclose(back.centres, q.centres) and len(q.centres) == 20 and abs(back.step - q.step) < 1e-12
    cell = {r.vec_id: r.cell for r in lists.select("vec_id", "cell").collect()}
    want = np.argmax(V._unit(v.astype(np.float32).astype(float)) @ q.centres.T, axis=1)
    assert np.mean([cell[i] == want[i] for i in range(3000)]) > 0.999

    queries = rows.where("vec_id % 20 = 0 OR vec_id = 9999").selectExpr("vec_id AS q_id", "v AS qv")
    ids = np.arange(3000)
    brute = _brute(ids, v.astype(np.float32).astype(float), ids[ids % 20 == 0], 5)
    whole = _by_query(V.search(spark, path, queries, 5, 4, others=True).collect())
    assert set(whole) == set(brute) and _recall(whole, brute) >= 0.9
    # small blocks share the hot list and change nothing
    monkeypatch.setattr(V, "LIST_ROWS", 70)
    monkeypatch.setattr(V, "QUERY_ROWS", 9)
    assert _by_query(V.search(spark, path, queries, 5, 4, others=True).collect()) == whole
    assert 1 <= needed <= 20 and _recall(_by_query(V.search(spark, path, queries, 5, others=True).collect()), brute) >= 0.9
    # no row outside the probed lists
    probed = {i: set(c) for i, c in zip(ids[::20], q.cells(V._unit(v[::20].astype(np.float32).astype(float)), 4).tolist(), strict=True)}
    assert all(cell[i] in probed[n] for n, found in whole.items() for i, _ in found)
    # what all lists miss, the codes have lost
    assert _recall(_by_query(V.search(spark, path, queries, 5, 20, others=True).collect()), brute) >= 0.98


def test_exact_neighbours_of_a_key(spark, crowded):
    v, rows = crowded
    keyed = rows.where("v IS NOT NULL").selectExpr("vec_id", "v", "vec_id % 7 AS k")
    queries = keyed.where("vec_id % 20 = 0").selectExpr("vec_id AS q_id", "v AS qv", "k AS qk")
    ids = np.arange(3000)
    want = _brute(ids, v.astype(np.float32).astype(float), ids[::20], 3, keys=ids % 7)
    found = _by_query(V.exact_top_k(queries, keyed, 3, queries["qk"], keyed["k"], others=True).collect())
    assert {q: [i for i, _ in r] for q, r in found.items()} == {q: [i for i, _ in r] for q, r in want.items()}


def test_nothing_to_index(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, v array<float>")
    V.build(none, str(tmp_path / "none"))
    assert V.search(spark, str(tmp_path / "none"), none.selectExpr("vec_id AS q_id", "v AS qv")).count() == 0
