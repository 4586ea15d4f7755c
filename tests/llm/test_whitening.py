import math

import numpy as np
import pytest

from tidemark.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int"


def brute(vectors, k=8):
    """From the whole matrix, by a dense eigensolver."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    gap = np.array([[(n * int(c) - int(s)) / n for c, s in zip(row, sums, strict=True)] for row in x])
    cov = gap.T @ gap / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return deviation, e, u, gap @ u / np.sqrt(e), e / np.trace(cov)


def held(got, vectors, ids):
    """The result of whiten() is the dense solver's, up to a sign for each component."""
    deviation, _, _, white, explained = brute(vectors)
    rows = {(r.vec_id, r.component): r for r in got}
    assert len(rows) == len(got) == white.size
    flip = np.sign([sum(rows[i, j + 1].whitened * white[k, j] for k, i in enumerate(ids)) for j in range(white.shape[1])])
    for k, i in enumerate(ids):
        for j in range(white.shape[1]):
            r = rows[i, j + 1]
            assert (r.n, r.deviation) == (len(ids), deviation[k])
            assert r.whitened == pytest.approx(flip[j] * white[k, j], abs=1e-9) and r.explained == pytest.approx(explained[j], rel=1e-12) and r.identity_error < 1e-11


def test_query_against_a_dense_solver(spark):
    rows = queries.read(spark, "/root/testdata/sf0.001", "embeddings").collect()
    held(queries.op13_whitening(spark, "/root/testdata/sf0.001").collect(), [r.embedding for r in rows], [r.vec_id for r in rows])


def test_odd_rows_are_left_out_and_many_partitions_are_added_by_branches(spark):
    rng = np.random.default_rng(4)
    good = (rng.standard_normal((300, 12)) * np.linspace(0.01, 2, 12)).astype(np.float32).tolist()
    good += [good[0]] * 150  # one vector makes up a third
    bad = [None, [None] * 12, [float("nan")] + [0.0] * 11, [float("inf")] * 12, [1.0, None] + [0.0] * 10, [1.0, 2.0], []]
    rows = [(k, v, 1, "x", 3) for k, v in enumerate(good + bad)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(40)).collect()
    held(got, good, list(range(len(good))))


def test_no_variance_no_rows(spark):
    df = lambda vectors: spark.createDataFrame([(k, v, 0, "", 0) for k, v in enumerate(vectors)], SCHEMA)
    for vectors in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]] * 3):
        assert whitening.whiten(df(vectors)).collect() == []
    # two directions only
    got = whitening.whiten(df([[0.0, 0.0, 1.0], [1.0, 0.0, 1.0], [0.0, 2.0, 1.0], [1.0, 2.0, 1.0]])).collect()
    assert {r.component for r in got} == {1, 2} and len(got) == 8 and max(r.identity_error for r in got) < 1e-12


def test_ids_of_any_type_and_repeated_rows(spark):
    df = spark.createDataFrame([("a", [1.0, 0.5]), ("a", [1.0, 0.5]), (None, [0.0, 3.0]), ("b", [-1.0, 0.25])], "name string, v array<double>")
    got = whitening.whiten(df, id_col="name", vector_col="v").collect()
    assert sorted(str(r.vec_id) for r in got) == ["None", "None", "a", "a", "a", "a", "b", "b"] and {r.n for r in got} == {4}


@pytest.mark.parametrize("shape", [(400, 150), (30, 200), (200, 3)])
def test_components_of_wide_and_narrow_matrices(shape):
    c = np.random.default_rng(1).standard_normal(shape) * np.linspace(1, 2, shape[1])
    c -= c.mean(axis=0)
    cov, calls = c.T @ c / shape[0], []

    def product(u):
        calls.append(u.shape)
        return c.T @ (c @ u) / shape[0]

    values, vectors = whitening.leading_components(product, shape[1], 8)
    want = np.linalg.eigvalsh(cov)[::-1][: len(values)]
    assert np.abs(values - want).max() < 1e-13 * want[0] and np.linalg.norm(cov @ vectors - vectors * values, axis=0).max() < 1e-14 * want[0] * 4
    assert len(calls) < 300 and max(s[1] for s in calls) <= 10


def test_large_deviations_are_exact(spark):
    df = spark.createDataFrame([(k, [float(k % 2) * 3e6, 0.0]) for k in range(64)], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    x = [math.floor(1024 * (k % 2) * 3e6) + 100000 for k in range(64)]
    want = {k: (64 * x[k] - sum(x)) ** 2 for k in range(64)}
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 1 << 63 else None) for r in got)
