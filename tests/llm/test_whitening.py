"""Whitening against Python's whole numbers and numpy, and its edge cases."""

import math
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from vitalrates.llm import queries, whitening


def expected(vectors):
    """x, n, sums, covariance in exact arithmetic."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(dim)]
    y = [[n * r[i] - sums[i] for i in range(dim)] for r in x]
    v = [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(dim)] for i in range(dim)]
    return x, n, sums, y, np.array([[float(a) for a in r] for r in v])


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long, v string, component int").repartition(parts)


def check(out, ids, vectors, components=8):
    _, n, _, y, covariance = expected(vectors)
    values, columns = np.linalg.eigh(covariance)
    values, columns = values[::-1][:components], columns[:, ::-1][:, :components]
    assert len(out) == len(vectors) * len(values)
    by_row = {}
    for r in out:
        assert r.n == n and r.explained == pytest.approx(values[r.component - 1] / np.trace(covariance), rel=1e-4)
        by_row.setdefault(r.vec_id, []).append(r)
    signs = None
    for i, own in zip(ids, y):
        got = sorted(by_row[i], key=lambda r: r.component)
        assert {r.deviation for r in got} == {sum(v * v for v in own)} and got[0].deviation_digits == str(got[0].deviation)
        w = np.array(own, float) / n @ columns / np.sqrt(values)
        g = np.array([r.whitened for r in got])
        signs = np.sign(w * g) if signs is None else signs
        np.testing.assert_allclose(g * signs, w, atol=1e-7)
        assert got[0].identity_error < 1e-4


def test_small_table(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(11, 11)) * 0.2
    vectors = (rng.normal(size=(90, 11)) @ mix + 0.3).astype(np.float32)
    rows = [(i, v.tolist(), 5, "x", 9) for i, v in enumerate(vectors)]
    odd = [(900, None, 1, "", 1), (901, [1.0, None] + [0.0] * 9, 1, "", 1), (902, [float("nan")] * 11, 1, "", 1),
           (903, [float("inf")] * 11, 1, "", 1), (904, [1.0, 2.0], 1, "", 1), (905, [], 1, "", 1)]
    out = whitening.whitened(frame(spark, rows + odd)).collect()
    check(out, range(90), vectors)
    errors = {r.identity_error for r in out}
    assert len(errors) == 1
    again = whitening.whitened(frame(spark, rows + odd, parts=1)).collect()
    assert {(r.vec_id, r.component): r.deviation for r in again} == {(r.vec_id, r.component): r.deviation for r in out}


def test_registered_query(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pydict()
    rows = [(i, v) for i, v in zip(table["vec_id"], table["embedding"]) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = queries.op11_whitening(spark, sf_dir)
    assert out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(out.collect(), [i for i, _ in rows], [v for _, v in rows])


def test_whole_numbers_beyond_longs(spark):
    vectors = [[1e14, 3.0], [-1e14, 5.0], [7e13, 8.5], [2.0, -4.0]]
    out = whitening.whitened(frame(spark, [(i, v, 0, "", 0) for i, v in enumerate(vectors)] + [(9, [1e30, 0.0], 0, "", 0)])).collect()
    x, n, _, y, covariance = expected(np.array(vectors, np.float32).tolist())
    for r in out:
        exact = sum(v * v for v in y[r.vec_id])
        assert r.deviation_digits == str(exact) and r.deviation == (exact if exact < 1 << 63 else None)
    fit = whitening.fit_whitening(frame(spark, [(i, v, 0, "", 0) for i, v in enumerate(vectors)]))
    assert fit.trace == pytest.approx(np.trace(covariance), rel=1e-12)


def test_exact_square_sums():
    rng = np.random.default_rng(1)
    for bits in (0, 3, 24, 25, 61):
        z = rng.integers(-(1 << bits), (1 << bits) + 1, size=(500, 3))
        assert whitening.square_sums(z) == [sum(int(v) ** 2 for v in c) for c in z.T]
    assert whitening.square_sums(np.zeros((0, 2), np.int64)) == [0, 0]


@pytest.mark.parametrize("rows, defined", [
    ([], None), ([(1, None)], None), ([(1, []), (2, [])], None), ([(1, [0.5, 1.0])], 0),
    ([(1, [0.5, 1.0])] * 3, 0), ([(1, [0.0, 1.0]), (None, [1.0, 1.0])], 1),
])
def test_edges(spark, rows, defined):
    out = whitening.whitened(frame(spark, [(i, v, 1, "x", 2) for i, v in rows])).collect()
    if defined is None:
        assert out == []
    else:
        assert len(out) == 2 * len(rows) and {r.component for r in out if r.whitened is not None} == set(range(1, defined + 1))
        assert all((r.identity_error is None) == (not defined) for r in out)
