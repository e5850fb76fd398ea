"""The stored index: exact search against all pairs, recall, additions."""

import numpy as np
import pytest

from presswork.operators import knn, vector_index
from presswork.operators.vector_index import VectorIndex

SIZE = 12


def clustered(spark, n=400, seed=3, start=0):
    """Unit vectors around ten directions, with exact copies and null, zero and odd rows."""
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(1).normal(size=(10, SIZE))
    rows = [(start + i, (middle[i % 10] + 0.15 * rng.normal(size=SIZE)).tolist()) for i in range(n)]
    rows += [(start + n + i, rows[5][1]) for i in range(60)]
    rows += [(start + n + 100, None), (start + n + 101, [0.0] * SIZE), (start + n + 102, [None] * SIZE), (start + n + 103, [float("nan")] * SIZE), (start + n + 104, [float("inf")] * SIZE)]
    return knn.unit_vectors(spark.createDataFrame(rows, "v long, e array<double>"), "v", "e")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    vectors = clustered(spark)
    return VectorIndex.build(vectors, str(tmp_path_factory.mktemp("index")), cells=12, size=SIZE), vectors


def rows(df):
    return sorted((r.anchor, r.rn, r.id, round(r.sim, 9)) for r in df.collect())


def brute(anchors, corpus, k):
    """By plain loops; ties by id."""
    full = lambda df: {r.id: np.array(r.ws) for r in df.collect()}
    mine, theirs, out = full(anchors), full(corpus), []
    for a, v in mine.items():
        best = sorted((-round(float(v @ w), 9), i) for i, w in theirs.items() if i != a)[:k]
        out += [(a, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_every_vector_is_filed_once(index):
    made, vectors = index
    assert sorted(r.id for r in made.filed().collect()) == sorted(r.id for r in vectors.collect()) and vectors.count() == 460
    assert made.cells().agg({"n": "sum"}).first()[0] == 460


@pytest.mark.parametrize("k, block", [(10, 1 << 15), (70, 7)])
def test_exact_search_equals_brute_force_with_ties(index, monkeypatch, k, block):
    monkeypatch.setattr(vector_index, "CELL_BLOCK", block)
    made, vectors = index
    asked = vectors.filter("id % 50 = 0 or id = 5")  # 5 has 60 exact copies
    found, share = made.exact(asked, k)
    assert rows(found) == brute(asked, vectors, k) == rows(knn.batch(asked, vectors, k))
    assert share < (0.5 if k == 10 else 1)


def test_recall_grows_with_the_probes(index):
    made, vectors = index
    asked = vectors.filter("id % 20 = 0")
    probes, share = made.probes_for(asked, 10, target=0.9)
    truth = made.exact(asked, 10)[0]
    got = vector_index.recall(made.search(asked, 10, probes), truth).agg({"n_found": "sum", "n_true": "sum"}).first()
    assert 0.9 <= share and got[0] / got[1] >= 0.9 and abs(max(got) and min(got) / max(got) - share) < 0.02
    assert rows(made.search(asked, 10, 1000)) == rows(truth)  # all cells


def test_vectors_are_added_without_another_fit(spark, index, tmp_path):
    _, vectors = index
    made = VectorIndex.build(vectors, str(tmp_path), cells=12, size=SIZE)
    before = made.centroids.copy()
    more = clustered(spark, 90, seed=9, start=10_000)
    made.add(more, 1)
    made.add(more, 1)  # a batch that runs again replaces itself
    again = VectorIndex(spark, str(tmp_path))
    assert (again.centroids == before).all() and again.filed().count() == vectors.count() + more.count()
    asked = more.filter("id % 30 = 0")
    assert rows(again.exact(asked, 5)[0]) == brute(asked, vectors.union(more), 5)


def test_small_indexes(spark, tmp_path):
    none = clustered(spark).limit(0)
    empty = VectorIndex.build(none, str(tmp_path / "empty"), size=SIZE)
    assert empty.filed().count() == 0 and empty.exact(clustered(spark), 3)[0].count() == 0
    assert empty.search(clustered(spark), 3).count() == 0 and empty.probes_for(none, 3) == (1, 1.0)
    one = clustered(spark).filter("id = 1")
    made = VectorIndex.build(one, str(tmp_path / "one"), size=SIZE)
    copies = knn.unit_vectors(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], "v long, e array<double>"), "v", "e")
    alike = VectorIndex.build(copies, str(tmp_path / "alike"), cells=5, size=2)
    assert rows(alike.exact(copies, 3)[0]) == brute(copies, copies, 3)
    assert made.exact(one, 3)[0].count() == 0 and rows(made.exact(one, 3, but_self=False)[0]) == [(1, 1, 1, 1.0)]
