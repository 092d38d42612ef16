"""Whitening against a dense eigenvalue decomposition."""

import numpy as np
import pytest

from lexiframe.llm import queries, whitening
from lexiframe.sources.tables import table


def dense(x):
    """n, S, eigenvalues and vectors, trace of the distinct rows of whole numbers `x`."""
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    c = (n * fit - sums) / n
    v = c.T @ c / n
    values, vectors = np.linalg.eigh(v)
    return n, sums, values[::-1], vectors[:, ::-1], np.trace(v)


def check(rows, vectors_of, most=16):
    """Rows of the query against the decomposition; components up to sign."""
    x = {k: np.floor(64.0 * np.array(v, "f8")).astype("i8") + 1_000_000 for k, v in vectors_of}
    n, sums, values, vectors, trace = dense(np.stack(list(x.values())))
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert got.keys() == x.keys()
    k = min(most, len(values))
    ids = list(x)
    want = np.stack([(n * x[i] - sums) / n @ vectors[:, :k] / np.sqrt(values[:k]) for i in ids])
    have = np.array([[got[i][c + 1]["whitened"] for c in range(k)] for i in ids])
    sign = np.sign((want * have).sum(0))
    assert np.abs(have * sign - want).max() < 1e-9
    for i in ids:
        assert len(got[i]) == k
        for c, r in got[i].items():
            assert r["n"] == n and r["deviation"] == int(sum(int(z) ** 2 for z in n * x[i] - sums))
            assert abs(r["explained"] * trace / values[c - 1] - 1) < 1e-9 and 0 <= r["identity_error"] < 1e-10


def test_query(spark, small):
    rows = table(spark, small, "embeddings").collect()
    check(queries.op11_whitening(spark, small).collect(), [(r["vec_id"], r["embedding"]) for r in rows])


def test_odd_rows(spark, folder):
    """Nulls, non-finite entries, empty and short vectors go; copies stay and are fitted once."""
    rng = np.random.default_rng(2)
    good = [(k, rng.normal(size=5).tolist()) for k in range(40)]
    good += [(100 + k, good[3][1]) for k in range(30)]
    odd = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [1.0, float("nan"), 0.0, 0.0, 0.0]),
           (204, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (205, [1.0, 2.0]), (206, [1e30, 0.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(k, v, "x", 1) for k, v in good + odd],
                                  "vec_id long, embedding array<double>, y string, WHITENED int")
    frame.write.parquet(f"{folder}/embeddings.parquet")
    check(queries.op11_whitening(spark, folder).collect(), good)


@pytest.mark.parametrize("vectors, n", [([], 0), ([[1.0, 2.0]], 1), ([[1.0, 2.0]] * 3, 1), ([None], 0)])
def test_no_variance(spark, vectors, n):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    white = whitening.whiten(frame)
    assert white.n == n and white.values == [] and all(r["whitened"] == [] for r in white.rows.collect())


def test_flat_dimensions_have_no_component(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(rng.normal()), 1.0, float(rng.normal()), 0.0]) for k in range(50)]
    white = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert len(white.values) == 2 and abs(sum(white.explained) - 1) < 1e-12


def matrix(width, seed, spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * spectrum @ q.T


@pytest.mark.parametrize("width, spectrum", [
    (300, lambda k: 0.98 ** k), (300, lambda k: 1 / (1 + k)), (200, lambda k: 1 + (k < 5)),
    (150, lambda k: 1.0 - k / 1000), (64, lambda k: 1e-6 ** (k / 64))])
def test_jacobi_davidson(width, spectrum):
    """Also with subspaces that are restarted, close eigenvalues and equal ones."""
    a = matrix(width, 3, spectrum(np.arange(width)))
    a = (a + a.T) / 2
    passes = []
    values, vectors = whitening.jacobi_davidson(lambda w: passes.append(w.shape[1]) or a @ w, width, 16)
    want = np.linalg.eigvalsh(a)[::-1][:16]
    assert np.abs(values - want).max() < 1e-13
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-13
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-13
    assert len(passes) < 150


def test_sums_in_groups_of_tasks(spark):
    rng = np.random.default_rng(5)
    frame = spark.createDataFrame([(k, rng.normal(size=3).tolist()) for k in range(900)],
                                  "vec_id long, embedding array<double>")
    rows, width = whitening.usable(frame)
    blocks = whitening.fit_list(rows, width)
    many = blocks.repartition(300)
    make = lambda y: (y * 1.0).sum(0)
    assert whitening.total(many, 3, make).tolist() == whitening.total(blocks, 3, make).tolist()
