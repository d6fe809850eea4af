import math
from fractions import Fraction

import numpy as np
import pytest
from colloquy.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def whole(v):
    return [math.floor(64 * float(c)) + 1_000_000 for c in v]


def brute(rows, most):
    """Exact means and deviations by fractions, components by a dense solver: (n, deviations, covariance, centred)."""
    xs = [whole(v) for _, v, *_ in rows]
    n, width = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(width)]
    deviations = [sum((n * x[i] - sums[i]) ** 2 for i in range(width)) for x in xs]
    centred = np.array([[float(Fraction(n * x[i] - sums[i], n)) for i in range(width)] for x in xs])
    return n, deviations, centred.T @ centred / n, centred


def make(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.mark.parametrize(("n", "width", "most"), [(200, 6, 4), (60, 40, 32), (500, 3, 32)])
def test_equals_dense_solver(spark, n, width, most):
    rng = np.random.default_rng(n)
    data = (rng.normal(size=(n, width)) @ rng.normal(size=(width, width)) + 50 * rng.normal(size=width)).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(data)]
    n, deviations, covariance, centred = brute(rows, most)
    out = whitening.whiten(make(spark, rows), most).collect()
    most = min(most, width)
    assert len(out) == n * most and {r.n for r in out} == {n}
    assert {(r.vec_id, int(r.deviation)) for r in out} == set(enumerate(deviations))
    got = np.zeros((n, most))
    for r in out:
        got[r.vec_id, r.component - 1] = r.whitened
    values = np.linalg.eigvalsh(covariance)[::-1][:most]
    shares = {r.component: r.explained for r in out}
    assert np.allclose([shares[k + 1] for k in range(most)], values / np.trace(covariance), rtol=1e-9)
    error = np.abs(got.T @ got / n - np.eye(most)).max()
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error <= 1e-9 and error <= 1e-9
    # components are eigenvectors: the covariance of data and whitened rows gives back vector and eigenvalue
    vectors = centred.T @ got / n / np.sqrt(values)
    assert np.allclose(covariance @ vectors, vectors * values, atol=1e-8 * values[0]) and np.allclose((vectors**2).sum(0), 1)


def test_null_and_odd_rows_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 5), float(i % 3)], 0) for i in range(20)] + [(7, [1.0, 2.0], 0), (None, [3.0, 1.0], 0)]
    bad = [(90, None, 0), (91, [], 0), (92, [1.0, None], 0), (93, [nan, 1.0], 0), (94, [1.0, -inf], 0), (95, [1.0], 0), (96, [1.0, 2.0, 3.0], 0), (97, [1e30, 0.0], 0)]
    out = whitening.whiten(make(spark, good + bad)).collect()
    assert sorted((str(r.vec_id), r.component) for r in out) == sorted((str(i), c) for i, *_ in good for c in (1, 2))
    assert {r.n for r in out} == {22}


def test_components_without_variance(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0], 0) for i in range(10)]
    out = whitening.whiten(make(spark, rows)).collect()
    assert {r.component for r in out if r.whitened is None} == {2, 3} and {r.explained for r in out if r.component > 1} == {0.0}
    assert max(r.identity_error for r in out) < 1e-9
    one = whitening.whiten(make(spark, rows[:1])).collect()
    assert len(one) == 3 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error == 0 for r in one)


def test_empty_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(make(spark, [(1, None, 0), (2, [None], 0)])).count() == 0


def test_deviations_beyond_64_bits_are_exact(spark):
    rows = [(i, [float(2**40 * (i % 7)), float(i)], 0) for i in range(300)]
    n, deviations, *_ = brute(rows, 2)
    out = whitening.whiten(make(spark, rows)).collect()
    assert {(r.vec_id, int(r.deviation)) for r in out} == set(enumerate(deviations)) and max(deviations) > 2**63


def test_further_columns_of_any_name_and_doubles(spark):
    rows = [(i, [float(i % 4), float(i % 3)], 1, 2.0, 3) for i in range(12)]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<double>, n int, whitened double, component int")
    out = whitening.whiten(frame)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 24
