import math
from collections import Counter

import numpy as np
import pytest

from rosterlake.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, vector string, n int, i int, q double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "v", 2, 3, 0.5) for i, v in rows], SCHEMA)


def usable(rows):
    return [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]


def brute(rows, k=8):
    ids = [i for i, _ in rows]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(axis=0)
    y = n * x - sums
    cov = np.array((y.T @ y) / n**3, float)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    white = np.array(y / n, float) @ vectors / np.sqrt(values)
    return ids, n, [int(v) for v in (y * y).sum(axis=1)], white, values / np.trace(cov), cov


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.linspace(0.3, 0.02, d) + rng.normal(size=d) + 0.2 * rng.normal(size=(n, 1))).tolist()


@pytest.mark.parametrize("n, d", [(300, 20), (50, 3)])
def test_rows_equal_brute_force(spark, n, d):
    rows = list(enumerate(vectors(n, n, d)))
    rows += [(9001, None), (9002, []), (9003, [float("nan")] * d), (9004, [float("inf")] + [0.0] * (d - 1)), (9005, [None] + [0.0] * (d - 1)), (9006, [1.0]), (None, rows[3][1]), (5, rows[5][1])]
    ids, n, deviation, white, explained, _ = brute([r for r in usable(rows) if len(r[1]) == d])
    got = whitening.by_component(whitening.whiten(frame(spark, rows).repartition(7))).collect()
    k = min(8, d)
    assert len(got) == len(ids) * k and {r.component for r in got} == set(range(1, k + 1)) and {r.n for r in got} == {n}
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter(zip(ids, deviation, strict=True))
    place = {i: p for p, i in enumerate(ids)}
    for c in range(k):
        mine = {r.vec_id: r.whitened for r in got if r.component == c + 1}
        a, b = np.array([mine[i] for i in place]), np.array([white[p, c] for p in place.values()])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        shares = {r.explained for r in got if r.component == c + 1}
        assert len(shares) == 1 and shares.pop() == pytest.approx(explained[c], rel=1e-10)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_covariances_come_out_of_square_sums():
    rng = np.random.default_rng(3)
    for scale in (1, 10**6, 2**45, 2**60):
        y = rng.integers(-scale, scale + 1, size=(9000, 5))
        exact = [[int(v) for v in r] for r in y.tolist()]
        want = [sum(r[i] ** 2 for r in exact) for i in range(5)]
        want += [sum((r[i] + r[j]) ** 2 for r in exact) for i in range(5) for j in range(i + 1, 5)]
        assert whitening.square_sums(y) == want


def test_covariance_matrix_is_exact_before_rounding(spark):
    rows = list(enumerate(vectors(8, 120, 6)))
    fitted = whitening.fit(frame(spark, rows))
    assert np.array_equal(fitted.covariance, brute(rows)[5])


def test_far_from_zero_and_hardly_varying(spark):
    """Means of 10^5 beside deviations of one unit: nothing may cancel."""
    rng = np.random.default_rng(1)
    rows = [(i, (1000.0 + rng.integers(0, 2, 4) / 512).tolist()) for i in range(200)]
    _, _, deviation, white, _, _ = brute(rows)
    got = whitening.by_component(whitening.whiten(frame(spark, rows))).collect()
    assert {r.vec_id: r.deviation for r in got} == dict(enumerate(deviation))
    assert got[0].identity_error < 1e-9 and np.isfinite([r.whitened for r in got]).all()


@pytest.mark.parametrize("rows, n", [([(1, [0.5, 0.25])], 1), ([(i, [0.5, 0.25]) for i in range(5)], 5)])
def test_without_variance(spark, rows, n):
    got = whitening.by_component(whitening.whiten(frame(spark, rows))).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(n, 0, None, None, None)] * (2 * n)


def test_fewer_vectors_than_dimensions(spark):
    got = whitening.by_component(whitening.whiten(frame(spark, list(enumerate(vectors(2, 3, 6)))))).collect()
    assert {r.component for r in got if r.whitened is not None} == {1, 2}
    assert sum(r.explained for r in got if r.vec_id == 0) == pytest.approx(1) and got[0].identity_error < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [float("nan")])]])
def test_no_usable_vector(spark, rows):
    assert whitening.by_component(whitening.whiten(frame(spark, rows))).collect() == []
