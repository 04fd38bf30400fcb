"""Whitening against exact covariances and eigenvectors of numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, whitening string"


def made(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, "kept") for i, v in enumerate(vectors)], SCHEMA).repartition(parts)


def exact(vectors):
    x = np.floor(np.array(vectors, np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    centred = (n * x - s).astype(float) / n
    values, right = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * x - s) ** 2).sum(1), centred, values[::-1], right[:, ::-1]


def test_components_equal_those_of_the_covariance(spark):
    r = np.random.default_rng(2)
    vectors = (r.normal(size=(700, 40)) @ np.diag(np.linspace(4, 0.2, 40))).tolist()
    awkward = [None, [], [1.0] * 39, [1.0] * 39 + [None], [float("nan")] + [0.0] * 39, [float("inf")] * 40, [1e38] * 40, [3.0]]
    n, deviation, centred, values, right = exact(vectors)
    rows = made(spark, vectors + awkward)
    model = whitening.fit(rows)
    assert model.n == n and model.components.shape == (40, 32) and model.passes >= 3
    assert np.allclose(model.eigenvalues, values[:32], rtol=1e-9)
    assert np.allclose(np.abs((model.components * right[:, :32]).sum(0)), 1, atol=1e-9)
    assert model.identity_error < 1e-9 and np.isclose(model.total, values.sum(), rtol=1e-10)
    got = {r["vec_id"]: r for r in whitening.whiten(rows, model).collect()}
    assert sorted(got) == list(range(n)) and {r["whitening"] for r in got.values()} == {"kept"}
    want = centred @ model.components / np.sqrt(model.eigenvalues)
    assert all(got[i]["_whitening"]["deviation"] == deviation[i] for i in range(n))
    assert np.allclose([got[i]["_whitening"]["whitened"] for i in range(n)], want, atol=1e-9)


@pytest.mark.parametrize("spread", [1e-1, 1e-3])
def test_small_directions_are_kept_apart(spark, spread):
    r = np.random.default_rng(3)
    vectors = (r.normal(size=(300, 6)) * [1e4, 1e3, 100, 10, 1, spread * 1000]).tolist()
    n, _, _, values, right = exact(vectors)
    model = whitening.fit(made(spark, vectors))
    assert np.allclose(model.eigenvalues, values, rtol=1e-6) and model.identity_error < 1e-6


def test_rank_and_ties(spark):
    r = np.random.default_rng(4)
    few = r.normal(size=(5, 12)).tolist()                        # rank 4 after centring
    model = whitening.fit(made(spark, few))
    assert model.components.shape == (12, 4) and model.identity_error < 1e-8
    same = made(spark, [[1.0, 2.0, 3.0]] * 7)
    model = whitening.fit(same)
    assert model.n == 7 and not len(model.eigenvalues)
    assert [r["_whitening"]["whitened"] for r in whitening.whiten(same, model).collect()] == [[]] * 7
    constant = [[float(a), 5.0, float(-a)] for a in range(9)]    # one direction only
    model = whitening.fit(made(spark, constant))
    assert model.components.shape == (3, 1) and model.identity_error < 1e-9


def test_nothing_to_fit(spark):
    for rows in (made(spark, []), made(spark, [None, [], [None]], 1)):
        model = whitening.fit(rows)
        assert model.n == 0 and whitening.whiten(rows, model).count() == 0


def test_deviation_beyond_a_long_is_null(spark):
    rows = made(spark, [[1e14, 0.0], [-1e14, 0.0], [0.0, 1.0]])
    got = whitening.whiten(rows, whitening.fit(rows)).orderBy("vec_id").collect()
    assert [r["_whitening"]["deviation"] for r in got][:2] == [None, None]


def test_query_counts_components_from_one(spark):
    got = whitening.op12(spark, "/root/testdata/sf0.001").cache()
    n = got.head()["n"]
    assert got.count() == n * 32 and got.agg(F.max("identity_error")).head()[0] <= 1e-9
    by = {r["component"]: r["explained"] for r in got.select("component", "explained").distinct().collect()}
    assert sorted(by) == list(range(1, 33)) and all(by[k] >= by[k + 1] for k in range(1, 32))
