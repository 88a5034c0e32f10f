"""Whitening: the spectral split and the whole operator against a plain eigendecomposition."""

import math

import numpy as np
import pytest

from terrace.llm import whitening


def _turned(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return q @ np.diag(values) @ q.T


CASES = {
    "sample": np.cov(np.random.default_rng(1).standard_normal((300, 40)).T),
    "one value": np.eye(12) * 3.0,
    "no variance": np.zeros((7, 7)),
    "two values": np.diag([1.0] * 9 + [2.0] * 9),
    "graded": _turned(10.0 ** -np.arange(0, 12, 0.25)),
    "close": _turned(1 + 1e-13 * np.arange(24)),
    "low rank": np.ones((10, 10)),
    "single": np.array([[2.0]]),
    "value at the mean": np.diag([3.0, 2.0, 1.0]),
}


@pytest.mark.parametrize("name", CASES)
def test_a_split_matrix_is_put_together_again(name):
    a = CASES[name]
    values, vectors = whitening.spectral_split(a)
    size = max(np.abs(a).max(), 1e-300)
    assert np.allclose(vectors.T @ vectors, np.eye(len(a)), atol=1e-13)
    assert np.abs((vectors * values) @ vectors.T - a).max() <= 1e-13 * size * len(a)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * size * len(a)


def test_the_polar_factor_is_the_sign_of_a_symmetric_matrix():
    a = _turned(np.array([5.0, 1.0, 1e-3, -1e-6, -2.0, -9.0]), 3)
    sign = whitening.polar_factor(a, 1e-8)
    values, vectors = np.linalg.eigh(a)
    assert np.abs(sign - (vectors * np.sign(values)) @ vectors.T).max() < 1e-9


def _plain(vectors, scale=64, most=32):
    x = np.floor(scale * np.array(vectors, np.float64))
    n = len(x)
    z = x - x.mean(axis=0)
    values, columns = np.linalg.eigh(z.T @ z / n)
    values, columns = values[::-1][:most], columns[:, ::-1][:, :most]
    sums = [int(s) for s in x.sum(axis=0)]
    deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return z @ columns / np.sqrt(values), deviation, values / np.trace(z.T @ z / n)


SCHEMA = "vec_id long, embedding array<float>"


def test_the_operator_equals_a_plain_version(spark):
    rng = np.random.default_rng(5)
    good = (rng.standard_normal((400, 40)) * np.linspace(0.2, 2, 40) + 3).astype(np.float32)
    odd = [None, [], [1.0] * 39, [math.nan] + [1.0] * 39, [math.inf] + [1.0] * 39, [None] + [1.0] * 39]
    rows = [(i, v.tolist()) for i, v in enumerate(good)] + [(1000 + i, v) for i, v in enumerate(odd)] + [(None, good[0].tolist()), (7, good[1].tolist())]
    table = spark.createDataFrame(rows, SCHEMA).repartition(130)  # more tasks than one group adds up
    model = whitening.fit(table)
    got = whitening.whitened(table, model).collect()
    want, deviation, shares = _plain([*good, good[0], good[1]])
    assert model.n == 402 and len(got) == 402
    by_id = {r.id: r for r in got if r.id not in (None, 7)}
    signs = np.sign(np.array(by_id[0].whitened)) * np.sign(want[0])
    for i in by_id:
        assert by_id[i].deviation == deviation[i]
        assert np.abs(np.array(by_id[i].whitened) * signs - want[i]).max() < 1e-9
    assert len([r for r in got if r.id is None]) == 1 and len([r for r in got if r.id == 7]) == 2
    assert np.abs(model.shares() - shares).max() < 1e-12
    assert whitening.identity_error(table, model) < 1e-9


def test_defined_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.fit(empty) is None and whitening.whitened(empty, None).isEmpty()
    assert whitening.fit(spark.createDataFrame([(1, None), (2, [])], SCHEMA)) is None
    flat = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], SCHEMA)
    model = whitening.fit(flat)
    got = whitening.whitened(flat, model).collect()
    assert len(got) == 5 and all(math.isnan(x) for r in got for x in r.whitened) and {r.deviation for r in got} == {0}
    assert whitening.identity_error(flat, model) == 0.0 and model.shares().tolist() == [0.0, 0.0]
    line = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(5)], SCHEMA)
    got = whitening.whitened(line, whitening.fit(line)).collect()
    assert all(not math.isnan(r.whitened[0]) and math.isnan(r.whitened[1]) for r in got)
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 1.0])], SCHEMA)
    assert {r.id: r.deviation for r in whitening.whitened(huge, whitening.fit(huge)).collect()}[1] is None
    tie = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])], SCHEMA)
    assert {r.id for r in whitening.whitened(tie, whitening.fit(tie)).collect()} == {3, 4}


def test_columns_with_clashing_names(spark):
    rows = [(i, [float(i), float(i * i % 7)], 1, 2, 3, 4, 5) for i in range(9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, v int, whitened int, deviation int, task int")
    plain = table.select("vec_id", "embedding")
    model = whitening.fit(table)
    got, want = (sorted(map(tuple, whitening.whitened(t, model).collect())) for t in (table, plain))
    assert got == want and len(got) == 9
