"""The lasso by cells against dense cross products, its optimality conditions, and its size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitalrates.operators.cell_lasso import Cells, cell_descent, cell_products, cell_tuning_table
from vitalrates.operators.lasso import coordinate_descent, cross_products, tuning_table
from vitalrates.operators.resample import bootstrap_weights
from vitalrates.plans import birthdate


def simulated(n, grids, years, seed=3):
    rng = np.random.default_rng(seed)
    g, h = rng.integers(0, grids, n), rng.integers(0, years, n)
    x = rng.normal(size=(n, 2)) + 0.1 * g[:, None]
    y = x @ [1.0, 0.5] + rng.normal(size=grids)[g] + rng.normal(size=years)[h] + 0.3 * rng.normal(size=(grids, years))[g, h]
    return g, h, x, y + rng.normal(size=n)


def cells_of(g, h, x, y):
    z = np.column_stack([np.ones(len(y)), x, y])
    keys, place = np.unique(np.column_stack([g, h]), axis=0, return_inverse=True)
    a, b = np.triu_indices(z.shape[1])
    sums = np.zeros((len(keys), len(a)))
    np.add.at(sums, place.ravel(), z[:, a] * z[:, b])
    return Cells.of(keys[:, 0], keys[:, 1], sums, x.shape[1]), place.ravel()


def dense_columns(g, h, x):
    dg, dh = np.eye(g.max() + 1)[g][:, 1:], np.eye(h.max() + 1)[h][:, 1:]
    return np.column_stack([x, dg, dh, (dg[:, :, None] * dh[:, None, :]).reshape(len(g), -1)])


@pytest.mark.parametrize("n", [60, 3000])  # with 60 rows many cells, some of them base ones, do not occur
def test_descent_meets_the_conditions_of_the_dense_problem(n):
    g, h, x, y = simulated(n, 5, 7)
    cells, place = cells_of(g, h, x, y)
    d = dense_columns(g, h, x)
    scale = d.std(axis=0)
    penalties = [0.3, 1e-4, 0.02]
    fits = cell_descent(cells, penalties)
    z = np.column_stack([np.ones(n), d, y])
    for penalty, fit, row in zip(penalties, fits, coordinate_descent(z.T @ z, penalties)):
        fitted = fit.offsets(cells)[place] + x @ fit.slopes
        products = [fit.cells.get((a, b), 0.0) for a in range(1, 5) for b in range(1, 7)]
        b = np.concatenate([fit.slopes, fit.first[1:], fit.second[1:], products])
        np.testing.assert_allclose(fit.intercept + d @ b, fitted, atol=1e-9)
        assert fit.squared_error(cells) == pytest.approx(((y - fitted) ** 2).sum())
        pull = d.T @ (y - fitted) / n
        assert abs((y - fitted).mean()) < 1e-6
        assert np.all(np.abs(pull) <= penalty * scale + 1e-6)
        np.testing.assert_allclose(pull[b != 0], (penalty * scale * np.sign(b))[b != 0], atol=1e-6)
        if n == 3000:
            np.testing.assert_allclose(z[:, :-1] @ row, fitted, atol=1e-4)


def test_tuning_equals_the_dense_table(spark):
    g, h, x, y = simulated(1500, 4, 5)
    rows = spark.createDataFrame(pd.DataFrame({
        "litter_id": np.arange(1500), "u": x[:, 0], "v": x[:, 1], "grid": g.astype(str), "year": 2000 + h, "part": y,
    }))
    roles = birthdate.Roles(numbers=("u", "v"))
    levels = {"grid": [str(k) for k in range(4)], "year": [str(2000 + k) for k in range(5)]}
    weighted = bootstrap_weights(rows, ["litter_id"], 6, 1).cache()
    wide, names = birthdate.design_columns(weighted, roles, levels)
    penalties = [1e-3, 0.05, 0.5]
    dense = tuning_table(cross_products(wide, names, "part", "weights", [0.0] * (len(names) + 1)), penalties)
    numbered = birthdate.level_numbers(weighted, roles, levels, ("a", "b"))
    short = cell_tuning_table(cell_products(numbered, ["u", "v"], "part", ("a", "b"), "weights", [0.1, -0.2, 1.0]), penalties, 2)
    both = dense.join(short.withColumnsRenamed({"n": "n2", "sse": "sse2"}), ["rep", "penalty"]).collect()
    assert len(both) == 18
    for r in both:
        assert r.n == r.n2 and r.sse2 == pytest.approx(r.sse, rel=1e-5)


def test_many_levels_take_a_line_per_cell(spark):
    """150 x 150 levels would be 22,500 columns; what is held are the cells that occur."""
    g, h, x, y = simulated(4000, 150, 150)
    cells, place = cells_of(g, h, x, y)
    fit = cell_descent(cells, [0.01])[0]
    pull = x.T @ (y - fit.offsets(cells)[place] - x @ fit.slopes) / 4000
    np.testing.assert_allclose(pull, 0.01 * x.std(axis=0) * np.sign(fit.slopes), atol=1e-6)
    rows = spark.createDataFrame(pd.DataFrame({"a": g, "b": h, "u": x[:, 0], "y": y, "w": [[1, 0, 2]] * 4000}))
    lines = cell_products(rows, ["u"], "y", ("a", "b"), "w", [0.0, 0.0])
    assert lines.count() == 3 * len(cells.n)
    assert lines.groupBy("rep").agg(F.sum(F.get("products", F.lit(0))).alias("n")).where("n = 4000 * greatest(rep, 1)").count() == 3


def test_replicates_without_rows_in_or_out_of_the_bag_do_not_count(spark):
    rows = spark.createDataFrame([(0, 0, 1.0, 2.0, [1, 0])] * 3, "a int, b int, u double, y double, w array<int>")
    tuned = cell_tuning_table(cell_products(rows, ["u"], "y", ("a", "b"), "w", [0.0, 0.0]), [0.1], 1)
    assert [r.n for r in tuned.collect()] == [0.0, 0.0]
    empty = cell_products(rows.limit(0), ["u"], "y", ("a", "b"), "w", [0.0, 0.0])
    assert cell_tuning_table(empty, [0.1], 1).count() == 0


def test_unfinished_rounds_raise():
    cells, _ = cells_of(*simulated(500, 4, 4))
    with pytest.raises(RuntimeError):
        cell_descent(cells, [0.01], rounds=1)
