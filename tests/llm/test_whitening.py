"""Embedding whitening against a dense eigensolver."""

import math

import numpy as np
import pytest

from tests.llm.test_operators import stored
from tidewell.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, key string, n string"


def table(spark, vectors, tmp_path_factory, ids=None):
    rows = [(k if ids is None else ids[k], v, "a", "b", "c") for k, v in enumerate(vectors)]
    return stored(spark.createDataFrame(rows, SCHEMA), tmp_path_factory)


def cases():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((300, 24)))[0]
    holes = rng.standard_normal((200, 24))
    holes[:, 5], holes[:, 9] = 0, holes[:, 3]
    return {
        "random": rng.standard_normal((400, 24)), "graded": rng.standard_normal((400, 24)) * np.logspace(0, -6, 24), "multiple": q * np.repeat([3.0, 2.0, 1.0, 0.5], 6),
        "equal": q, "few rows": rng.standard_normal((10, 24)), "deficient": holes, "one direction": np.ones((50, 24)), "one dimension": rng.standard_normal((9, 1)),
    }


@pytest.mark.parametrize("name", sorted(cases()))
def test_solver(name):
    a = cases()[name]
    r = np.zeros((a.shape[1],) * 2)
    some = np.linalg.qr(a, mode="r")
    r[: len(some)] = some
    diag, upper, v = whitening.bidiagonalise(r)
    want = np.linalg.svd(r, compute_uv=False)
    assert np.abs(np.sqrt(whitening.squared_singular_values(diag, upper)) - want).max() < 1e-13 * want.max()
    assert np.abs(v.T @ v - np.eye(len(v))).max() < 1e-13
    values, vectors, trace = whitening.principal(r, len(a), a.shape[1])
    assert len(values) == np.linalg.matrix_rank(a) and abs(trace - (a * a).sum() / len(a)) < 1e-10 * trace
    cov = a.T @ a / len(a)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-10
    assert np.abs(cov @ vectors - vectors * values).max() < 1e-13 * values.max()


def test_small_values_keep_their_digits():
    d = np.array([1.0, 1e-3, 1e-6, 1e-9, 1e-12])
    upper = np.array([0.5, 1e-4, 1e-7, 1e-10])
    got = np.sqrt(whitening.squared_singular_values(d, upper))
    want = np.linalg.svd(np.diag(d) + np.diag(upper, 1), compute_uv=False)
    assert np.allclose(got[:4], want[:4], rtol=1e-9) and math.isclose(np.prod(got), np.prod(d), rel_tol=1e-12)


def direct(vectors, components):
    """{row: (deviation, |whitened|)} by a dense covariance."""
    ok = [k for k, v in enumerate(vectors) if v is not None and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([vectors[k] for k in ok], dtype=np.float32).astype(float)).astype(int) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return {k: (int(((n * x[i] - s) ** 2).sum()), np.abs(c[i] @ v / np.sqrt(e))) for i, k in enumerate(ok)}, e / np.trace(c.T @ c / n)


def test_whitened_rows(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    vectors = [[float(np.float32(c)) for c in v] for v in rng.standard_normal((120, 6)) * np.arange(1, 7)]
    vectors += [vectors[0]] * 40  # a third of all rows is one vector
    vectors += [None, [], [1.0] * 5, [None] * 6, [1.0, 2.0, float("nan"), 0.0, 0.0, 0.0], [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]]
    df = table(spark, vectors, tmp_path_factory).repartition(40)  # more parts than one merge takes
    want, explained = direct(vectors, 4)
    got = whitening.whitened_components(df, components=4).collect()
    assert len(got) == 4 * len(want) and {r["n"] for r in got} == {160}
    for r in got:
        k = r["component"] - 1
        assert r["deviation"] == want[r["vec_id"]][0]
        assert abs(abs(r["whitened"]) - want[r["vec_id"]][1][k]) < 1e-9 and abs(r["explained"] - explained[k]) < 1e-12 and r["identity_error"] < 1e-9
    white = np.array([[r["whitened"] for r in sorted((r for r in got if r["component"] == k), key=lambda r: r["vec_id"])] for k in (1, 2, 3, 4)])
    assert np.abs(np.cov(white, bias=True) - np.eye(4)).max() < 1e-9  # one sign for all rows


def test_repeated_and_null_ids(spark, tmp_path_factory):
    vectors = [[float(a), float(b)] for a, b in [(0, 0), (1, 2), (3, 1), (5, 5)]]
    got = whitening.whitened_components(table(spark, vectors, tmp_path_factory, [7, 7, None, None])).collect()
    assert sorted((r["vec_id"] is None, r["component"]) for r in got) == sorted([(False, 1), (False, 2), (True, 1), (True, 2)] * 2)


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, []]])
def test_nothing_to_whiten(spark, tmp_path_factory, vectors):
    assert whitening.whitened_components(table(spark, vectors, tmp_path_factory)).collect() == []


def test_exact_beyond_long():
    big = whitening.centred(np.array([[2**61, -(2**61)]]), 9, [3, 4])
    assert big.tolist() == [[9 * 2**61 - 3, -9 * 2**61 - 4]]
