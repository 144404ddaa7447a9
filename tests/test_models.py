import dataclasses
import os
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks import operators
from vitalrates.functions.casting import inverse_logit
from vitalrates.operators import crossed, effects, laplace, ranking
from vitalrates.operators.lasso import coordinate_descent, cross_products, penalty_scores, tuning_table
from vitalrates.operators.laplace import gradient, settle
from vitalrates.operators.mixed import fit_mixed_logit
from vitalrates.operators.mixed_system import (
    DriverLevels, State, _packed_scan, _scan, following, newton, prepare, rescaled_lines, rule_of,
)
from vitalrates.operators.resample import bootstrap_weights, exact_bootstrap, poisson_limits
from vitalrates.operators.residual_checks import kolmogorov_tail, residual_tests, residual_trend
from vitalrates.operators.residuals import normal_quantile, quantile_residuals
from vitalrates.operators.scores import add_scores, first_components
from vitalrates.plans import birthdate
from vitalrates.plans.figures import normal_ellipse, robust_ellipse
from vitalrates.session import ensure_checkpoint_dir
from vitalrates.sources.models import load_mixed_fit, save_mixed_fit


def simulated(n=1500, litters=200, dams=90, years=6, seed=5):
    rng = np.random.default_rng(seed)
    dam_of = rng.integers(0, dams, litters)
    litter, year = rng.integers(0, litters, n), rng.integers(0, years, n)
    dam = dam_of[litter]
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    eta = -0.5 + 0.5 * x1 - 0.4 * x2 + (rng.normal(size=years) * 0.4)[year] + (rng.normal(size=dams) * 0.7)[dam]
    eta += (rng.normal(size=litters) * 0.5)[litter]
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float)
    return pd.DataFrame(dict(y=y, one=1.0, x1=x1, x2=x2, year=year, dam=dam, litter=litter))


def dense_fit(data, sds, groups):
    """Laplace fit with every level as a column, by plain Newton steps."""
    x = data[["one", "x1", "x2"]].to_numpy()
    z = np.hstack([np.eye(data[g].max() + 1)[data[g]] * sds[g] for g in groups])
    s, y = np.hstack([x, z]), data["y"].to_numpy()
    penalty = np.diag([0.0] * 3 + [1.0] * z.shape[1])
    c = np.zeros(s.shape[1])
    for _ in range(30):
        mu = 1 / (1 + np.exp(-s @ c))
        hessian = s.T @ (s * (mu * (1 - mu))[:, None]) + penalty
        c = c + np.linalg.solve(hessian, s.T @ (y - mu) - penalty @ c)
    eta = s @ c
    deviance = -2 * (y @ eta - np.logaddexp(0, eta).sum()) + c[3:] @ c[3:] + np.linalg.slogdet(hessian[3:, 3:])[1]
    return c[:3], np.linalg.inv(hessian)[:3, :3], deviance, c[3:]


@pytest.mark.parametrize("driver_levels", [10_000, 10])
def test_mixed_fit_equals_dense_algebra(spark, driver_levels):
    data = simulated()
    sds = {"year": 0.5, "dam": 0.7, "litter": 0.5}
    fit = fit_mixed_logit(
        spark.createDataFrame(data), "y", ["one", "x1", "x2"], ["year", "dam", "litter"], sds=sds,
        driver_levels=driver_levels,
    )
    beta, covariance, deviance, u = dense_fit(data, sds, ["year", "dam", "litter"])
    assert fit.beta == pytest.approx(beta, abs=1e-6)
    assert fit.covariance == pytest.approx(covariance, abs=1e-6)
    assert fit.minus_two_loglik == pytest.approx(deviance, abs=1e-4)
    dams = {int(r["level"]): r["effect"] for r in fit.effects["dam"].collect()}
    assert [dams[i] for i in sorted(dams)] == pytest.approx([u[6 + i] * 0.7 for i in sorted(dams)], abs=1e-5)


def dense_deviance(data, beta, sds, groups):
    """Laplace deviance at given fixed effects, the random effects at their mode."""
    x = data[["one", "x1", "x2"]].to_numpy()
    z = np.hstack([np.eye(data[g].max() + 1)[data[g]] * s for g, s in zip(groups, sds)])
    y, u = data["y"].to_numpy(), np.zeros(z.shape[1])
    for _ in range(30):
        mu = 1 / (1 + np.exp(-x @ beta - z @ u))
        hessian = z.T @ (z * (mu * (1 - mu))[:, None]) + np.eye(len(u))
        step = np.linalg.solve(hessian, z.T @ (y - mu) - u)
        u = u + step
        if np.abs(step).max() < 1e-9:
            break
    eta = x @ beta + z @ u
    return -2 * (y @ eta - np.logaddexp(0, eta).sum()) + u @ u + np.linalg.slogdet(hessian)[1]


def dense_slope(f, at, h=1e-4):
    return np.array([(f(at + h * e) - f(at - h * e)) / (2 * h) for e in np.eye(len(at))])


@pytest.fixture(scope="module")
def dense_minimum():
    """Fixed effects and log deviations at the smallest dense deviance, by quasi-Newton steps with differences."""
    data, groups = simulated(), ["year", "dam", "litter"]
    f = lambda v: dense_deviance(data, v[:3], np.exp(v[3:]), groups)
    at = np.array([-0.4, 0.4, -0.3, -1.0, -0.4, -0.8])
    inverse, slope = np.diag([0.004, 0.003, 0.003, 0.2, 0.2, 0.2]), dense_slope(f, at)
    for _ in range(60):
        step, reach = -inverse @ slope, 1.0
        while f(at + reach * step) > f(at):
            reach /= 2
        new = at + reach * step
        after = dense_slope(f, new)
        s, y = new - at, after - slope
        if s @ y > 1e-12:
            left = np.eye(6) - np.outer(s, y) / (s @ y)
            inverse = left @ inverse @ left.T + np.outer(s, s) / (s @ y)
        at, slope = new, after
        if slope @ inverse @ slope < 1e-8:
            return at, f(at)
    raise AssertionError("no dense minimum")


@pytest.mark.parametrize("driver_levels, stop, exact", [(10_000, 1e-6, 1e-3), (10, 1e-3, 5e-3)])
def test_search_minimises_the_joint_deviance(spark, dense_minimum, driver_levels, stop, exact):
    """The same fixed effects and deviations on the driver and on the executors, equal to dense algebra."""
    groups = ["year", "dam", "litter"]
    fit = fit_mixed_logit(
        spark.createDataFrame(simulated()), "y", ["one", "x1", "x2"], groups, driver_levels=driver_levels, stop=stop)
    at, least = dense_minimum
    assert fit.minus_two_loglik == pytest.approx(least, abs=1e-3)
    assert fit.beta == pytest.approx(at[:3], abs=exact)
    assert [np.log(fit.sds[g]) for g in groups] == pytest.approx(at[3:], abs=1e-2)
    errors = np.sqrt(np.diag(fit.covariance))
    assert all(abs(fit.beta - [-0.5, 0.5, -0.4]) < 3 * errors)
    assert fit.aic == pytest.approx(fit.minus_two_loglik + 12)


@pytest.mark.parametrize("groups", [["year", "dam", "litter"], ["year"], ["litter"], ["dam", "litter"]])
def test_gradient_of_the_deviance(spark, groups):
    data, beta = simulated(500), np.array([-0.2, 0.3, -0.6])
    sds = dict(zip(groups, (0.6, 0.9, 0.4)))
    df = spark.createDataFrame(data)
    for driver_levels in (10_000, 10):
        problem = prepare(df, "y", ["one", "x1", "x2"], groups, 64, driver_levels)
        start = np.concatenate([beta, np.zeros(problem.size - 3)])
        seen, _ = settle(problem, State(tuple(sds[g] for g in problem.factors), start), 1e-10, hold=True)
        fixed, random = gradient(problem, seen)
        problem.stored.unpersist()
        f = lambda v: dense_deviance(data, v[:3], np.exp(v[3:]), problem.factors)
        at = np.concatenate([beta, np.log([sds[g] for g in problem.factors])])
        assert seen.objective == pytest.approx(f(at), abs=1e-6)
        assert np.concatenate([fixed, random]) == pytest.approx(dense_slope(f, at), abs=1e-4)


@pytest.mark.parametrize("driver_levels", [10_000, 10])
def test_gradient_along_the_joint_mode(spark, driver_levels):
    data, groups = simulated(500), ["year", "dam", "litter"]
    problem = prepare(spark.createDataFrame(data), "y", ["one", "x1", "x2"], groups, 64, driver_levels)
    logs = np.log([0.6, 0.9, 0.4])
    sds = dict(zip(groups, np.exp(logs)))
    seen, _ = settle(problem, State(tuple(sds[g] for g in problem.factors), np.zeros(problem.size)), 1e-10)
    found = dict(zip(problem.factors, gradient(problem, seen, joint=True)[1]))
    problem.stored.unpersist()
    slope = dense_slope(lambda v: dense_fit(data, dict(zip(groups, np.exp(v))), groups)[2], logs)
    assert [found[g] for g in groups] == pytest.approx(slope, abs=1e-4)


def test_no_groups_is_a_plain_logit(spark):
    data = simulated(400)
    df = spark.createDataFrame(data)
    fit = fit_mixed_logit(df, "y", ["one", "x1", "x2"])
    plain = {r["term"]: r for r in effects.fit_plain_logit(df, "y", ["x1", "x2"]).collect()}
    for name, b, v in zip(["constant", "x1", "x2"], fit.beta, np.diag(fit.covariance)):
        assert b == pytest.approx(plain[name]["estimate"], abs=1e-5)
        assert v**0.5 == pytest.approx(plain[name]["std_error"], abs=1e-4)


def crossed_data(n=700):
    """Three factors, none nested in another, two of them above the bound of the dense system."""
    data = simulated(n)
    rng = np.random.default_rng(9)
    return data.assign(dam=rng.integers(0, 90, n), litter=rng.integers(0, 120, n))


def test_crossed_factors_equal_dense_algebra(spark):
    data, sds = crossed_data(), {"year": 0.4, "dam": 0.8, "litter": 0.6}
    groups = ["year", "dam", "litter"]
    codes = data.assign(**{g: data[g].astype("category").cat.codes for g in groups})
    fit = fit_mixed_logit(spark.createDataFrame(data), "y", ["one", "x1", "x2"], groups, sds=sds)
    beta, covariance, deviance, u = dense_fit(codes, sds, groups)
    assert fit.beta == pytest.approx(beta, abs=1e-4)
    assert fit.covariance == pytest.approx(covariance, abs=1e-6)
    assert 0 < fit.deviance_error < 2 and abs(fit.minus_two_loglik - deviance) < 4 * fit.deviance_error
    dams = {int(r["level"]): r["effect"] for r in fit.effects["dam"].collect()}
    start = codes["year"].max() + 1
    assert [dams[i] for i in sorted(dams)] == pytest.approx(u[start:start + len(dams)] * 0.8, abs=1e-4)
    assert fit.level_counts == {g: data[g].nunique() for g in groups}


def test_log_determinant_is_exact_for_few_levels(spark):
    data = simulated(300)
    problem = crossed.prepare_crossed(spark.createDataFrame(data), "y", ["one", "x1", "x2"], ["year"])
    system = crossed.mode(problem, [0.7], np.zeros(problem.size), 1e-10)
    assert crossed.deviance(problem, system) == (pytest.approx(dense_fit(data, {"year": 0.7}, ["year"])[2], abs=1e-6), 0.0)


def test_crossed_search_finds_the_least_deviance(spark):
    """No other deviation nearby has a smaller dense deviance, but for the error of the probes."""
    data = simulated(300)
    codes = data.assign(litter=data["litter"].astype("category").cat.codes)
    problem = crossed.prepare_crossed(spark.createDataFrame(data), "y", ["one", "x1", "x2"], ["litter"])
    (sd,), system = crossed.search(problem, [0.5], 1e-4, 0.1, (-7.0, 3.0), 0.7)
    dense = {a: dense_fit(codes, {"litter": sd * a}, ["litter"])[2] for a in (0.4, 0.6, 0.8, 1.0, 1.25, 1.6, 2.5)}
    assert dense[1.0] < min(dense.values()) + 0.5
    assert system.at[:3] == pytest.approx(dense_fit(codes, {"litter": sd}, ["litter"])[0], abs=1e-2)


def test_given_deviations_must_name_the_factors(spark):
    with pytest.raises(ValueError, match="deviations given"):
        fit_mixed_logit(spark.createDataFrame(simulated(50)), "y", ["one"], ["litter"], sds={"liter": 1.0})


def test_effect_tables(spark):
    fit = fit_mixed_logit(
        spark.createDataFrame(simulated(500)), "y", ["one", "x1", "x2"], ["year"], sds={"year": 0.4})
    table = {r["term"]: r for r in effects.fixed_effects(spark, fit).collect()}
    assert table["x1"]["z"] == pytest.approx(fit.beta[1] / fit.covariance[1, 1] ** 0.5)
    tests = {r["term"]: r for r in effects.wald_tests(spark, fit, {"a": ["x1"], "b": ["x2"]}).collect()}
    assert tests["a"]["chi_square"] == pytest.approx(table["x1"]["z"] ** 2)
    assert tests["a"]["p"] == pytest.approx(table["x1"]["p"], rel=1e-9)
    assert effects.chi_square_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert effects.chi_square_tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert effects.chi_square_tail(11.070497693516351, 5) == pytest.approx(0.05)


def test_normal_quantile(spark):
    df = spark.createDataFrame([(0.975,), (0.5,), (0.001,), (0.999,), (0.0,)], "p double")
    got = [r[0] for r in df.select(normal_quantile(F.col("p"))).collect()]
    assert got[:4] == pytest.approx([1.959963984540054, 0.0, -3.090232306167813, 3.090232306167813], abs=1e-7)
    assert got[4] is None


def test_lasso_solves_its_conditions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4)) * [1, 10, 0.1, 3]
    y = x @ [2, 0, 5, -1] + rng.normal(size=300)
    z = np.column_stack([np.ones(300), x, y])
    for penalty, row in zip([1e-10, 0.1, 1.0], coordinate_descent(z.T @ z, [1e-10, 0.1, 1.0])):
        residual = y - row[0] - x @ row[1:]
        gradient = (x - x.mean(0)).T @ residual / 300 / x.std(0)
        assert residual.mean() == pytest.approx(0, abs=1e-8)
        for g, b in zip(gradient, row[1:]):
            assert g == pytest.approx(np.sign(b) * penalty, abs=1e-6) if b else abs(g) <= penalty + 1e-6


def test_bootstrap_weights_have_no_upper_end():
    steps = 1 << 52
    limits = poisson_limits(steps)
    assert len(limits) > 15 and limits == sorted(set(limits)) and steps - limits[-1] > 1
    assert limits[0] == int(Decimal(-1).exp() * steps) and limits[1] == int(2 * Decimal(-1).exp() * steps)


def test_unfinished_descent_raises():
    x = np.random.default_rng(3).normal(size=(50, 3))
    z = np.column_stack([np.ones(50), x + x[:, :1], x.sum(axis=1)])
    with pytest.raises(RuntimeError):
        coordinate_descent(z.T @ z, [0.1], rounds=1)


def test_tuning_equals_row_by_row_replicates(spark):
    rng = np.random.default_rng(2)
    data = pd.DataFrame({"id": np.arange(400), "x0": rng.normal(size=400), "x1": rng.normal(size=400)})
    data["y"] = 3 * data["x0"] + rng.normal(size=400) + 50
    weighted = bootstrap_weights(spark.createDataFrame(data), ["id"], times=3)
    tuned = tuning_table(cross_products(weighted, ["x0", "x1"], "y", "weights", [0.0, 0.0, 50.0]), [0.01, 0.5])
    got = {(r["rep"], r["penalty"]): r["sse"] / r["n"] for r in tuned.collect()}
    rows = weighted.toPandas().sort_values("id")
    for rep in range(3):
        w = np.array([v[rep] for v in rows["weights"]])
        z = np.column_stack([np.ones(400), rows[["x0", "x1", "y"]]])
        fits = coordinate_descent(z.T @ (z * w[:, None]), [0.01, 0.5])
        out = w == 0
        for penalty, c in zip([0.01, 0.5], fits):
            error = rows["y"][out] - c[0] - rows[["x0", "x1"]][out] @ c[1:]
            assert got[rep, penalty] == pytest.approx((error**2).mean(), rel=1e-6)
    assert penalty_scores(tuned).count() == 2


def test_birth_dates(spark, tmp_path):
    from vitalrates.sources.models import load_model, save_model

    rng = np.random.default_rng(3)
    n = 600
    data = pd.DataFrame({
        "litter_id": np.arange(n), "grid": rng.choice(["KL", "SU"], n), "year": rng.choice([2001, 2002], n),
        "n1_weight": rng.normal(50, 5, n), "n1_date": rng.normal(150, 10, n), "litter_size": rng.integers(1, 6, n),
    })
    data["part"] = data["n1_date"] - 0.5 * data["n1_weight"] + 4 * (data["grid"] == "SU") + rng.normal(size=n)
    fit = birthdate.fit_birth_date_model(spark.createDataFrame(data), times=5, penalties=[1e-6, 0.1, 5.0])
    assert fit.penalty < 5 and fit.metrics["rmse"] < 1.3 and fit.metrics["r2"] > 0.95
    rows = spark.createDataFrame(
        [("KL", 2001, 50.0, 150.0, 3, None), ("KL", 2001, None, 150.0, 3, None), ("XX", 2001, 50.0, 150.0, 3, None),
         ("KL", 1999, 50.0, 150.0, 3, None), ("KL", 2001, 50.0, 150.0, 3, 99)],
        "grid string, year int, n1_weight double, n1_date double, litter_size int, part int",
    )
    filled = [r["part"] for r in birthdate.impute_birth_dates(rows, fit.model).collect()]
    assert filled[1:] == [None, None, None, 99] and abs(filled[0] - 125) <= 2
    save_model(fit.model, str(tmp_path / "model"))
    again = [r["part"] for r in birthdate.impute_birth_dates(rows, load_model(str(tmp_path / "model"))).collect()]
    assert again == filled


def test_component_scores(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=300)
    data = pd.DataFrame({"a": base + rng.normal(size=300), "b": -base + rng.normal(size=300), "c": rng.normal(size=300)})
    df = spark.createDataFrame(data)
    part = first_components(df, {"s": ("a", "b", "c")})["s"]
    got = add_scores(df, {"s": ("a", "b", "c")}).agg(F.avg("s").alias("m"), F.var_samp("s").alias("v")).first()
    assert got["m"] == pytest.approx(0, abs=1e-9) and got["v"] == pytest.approx(part.variance)
    assert part.variance == pytest.approx(np.linalg.eigvalsh(data.corr())[-1])
    assert max(part.loadings, key=abs) > 0
    with pytest.raises(ValueError):
        first_components(df.withColumn("c", F.lit(1.0)), {"s": ("a", "c")})


def test_ellipses(spark):
    rng = np.random.default_rng(6)
    xy = rng.multivariate_normal([1, 2], [[2, 1], [1, 3]], 3000)
    df = spark.createDataFrame(pd.DataFrame(xy, columns=["x", "y"]))
    e = normal_ellipse(df, "x", "y")
    d = xy - [e.x, e.y]
    inside = np.einsum("ij,jk,ik->i", d, np.linalg.inv([[e.xx, e.xy], [e.xy, e.yy]]), d) <= e.radius2
    assert abs(inside.mean() - 0.95) < 0.015
    outline = e.outline(spark, "x", "y").toPandas()[["x", "y"]].to_numpy() - [e.x, e.y]
    on = np.einsum("ij,jk,ik->i", outline, np.linalg.inv([[e.xx, e.xy], [e.xy, e.yy]]), outline)
    assert on == pytest.approx(np.full(52, e.radius2))
    spoiled = df.union(spark.createDataFrame([(500.0, -500.0)] * 20, "x double, y double"))
    r = robust_ellipse(spoiled, "x", "y")
    assert abs(r.x - 1) < 0.2 and abs(r.y - 2) < 0.2 and normal_ellipse(spoiled, "x", "y").xx > 100 * r.xx / 10


def test_inverse_logit(spark):
    assert spark.range(1).select(inverse_logit(F.lit(0.0))).first()[0] == 0.5


def test_exact_bootstrap(spark):
    """n draws a replicate, whatever the partitioning, through two tiers of the tree; counts follow the binomial law."""
    df = spark.range(3000).select("id", F.lit("x").alias("__place_of"), F.array(F.col("id")).alias("kept"))
    drawn = exact_bootstrap(df, ["id"], times=6, leaf_rows=2)
    got = {r["id"]: list(r["weights"]) for r in drawn.collect()}
    assert len(got) == 3000 and drawn.columns == [*df.columns, "weights"]
    weights = np.array([got[i] for i in range(3000)])
    assert (weights.sum(axis=0) == 3000).all() and weights.min() == 0
    assert abs((weights == 0).mean() - 0.3679) < 0.02 and abs(weights.var() - 1) < 0.08
    assert np.corrcoef(weights.T)[np.triu_indices(6, 1)] == pytest.approx(np.zeros(15), abs=0.09)
    again = {r["id"]: list(r["weights"]) for r in exact_bootstrap(df.repartition(7), ["id"], times=6, leaf_rows=2).collect()}
    assert again == got
    other = {r["id"]: list(r["weights"]) for r in exact_bootstrap(df, ["id"], times=6, seed=2, leaf_rows=2).collect()}
    assert other != got


def test_exact_bootstrap_edges(spark):
    assert exact_bootstrap(spark.range(0), ["id"], times=3).collect() == []
    assert [list(r["weights"]) for r in exact_bootstrap(spark.range(1), ["id"], times=3).collect()] == [[1, 1, 1]]
    missing = spark.createDataFrame([(None, 1), ("\\N", 2), ("a", 3)], "k string, v int")
    assert sum(r["weights"][0] for r in exact_bootstrap(missing, ["k"], times=1).collect()) == 3
    for repeats in (2, 20_000):
        with pytest.raises(Exception, match="repeat"):
            exact_bootstrap(spark.range(repeats).select(F.lit(1).alias("id")), ["id"], times=2).collect()


def test_tuning_with_exact_draws(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    data = pd.DataFrame({"id": range(400), "a": x[:, 0], "b": x[:, 1], "g": "u", "h": "v", "y": 2 * x[:, 0] + rng.normal(size=400)})
    roles = birthdate.Roles(identifier="id", numbers=("a", "b"), factors=("g", "h"), outcome="y")
    tuned = birthdate.tune(spark.createDataFrame(data), roles, {"g": ["u"], "h": ["v"]}, 10, [0.01, 1.0], exact_draws=True)
    found = {r["penalty"]: r["rmse"] for r in tuned.collect()}
    assert 0.9 < found[0.01] < 1.15 < found[1.0]


def simulated_residuals(spark, n=4000, shift=0.0):
    rng = np.random.default_rng(8)
    link = np.round(rng.normal(size=n), 2)
    y = (rng.random(n) < 1 / (1 + np.exp(-(link + shift * link**2)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "link": link, "draw": rng.random(n)}))
    return quantile_residuals(df, "y", "link", draw=F.col("draw"))


def test_residual_checks_tell_a_wrong_curve(spark):
    right = {r["test"]: r for r in residual_tests(simulated_residuals(spark), "y", "link", "residual").collect()}
    assert min(r["p"] for r in right.values()) > 0.01
    wrong = {r["test"]: r for r in residual_tests(simulated_residuals(spark, shift=1.0), "y", "link", "residual").collect()}
    assert wrong["trend_0.5"]["p"] < 1e-6 and wrong["uniformity"]["p"] < 1e-6
    # About 1.36 over the root of n is the 5 % point.
    assert kolmogorov_tail(1.358 / 1000, 10**6) == pytest.approx(0.05, abs=1e-3)


@pytest.mark.parametrize("links", ["many", "one", "hot"])
def test_residual_trend_equals_numpy(spark, links):
    rng = np.random.default_rng(2)
    link = {"many": rng.normal(size=700), "one": np.zeros(700), "hot": np.where(rng.random(700) < 0.4, 0.5, rng.normal(size=700))}[links]
    u = np.round(rng.random(700), 2) if links == "hot" else rng.random(700)
    data = pd.DataFrame({"l": link, "u": u})
    extra = spark.createDataFrame([(None, 0.5), (1.0, None)], "l double, u double")
    got = residual_trend(spark.createDataFrame(data).union(extra), "l", "u", bins=7).collect()
    upto = data["l"].map(lambda v: (data["l"] <= v).sum())
    data["bin"] = (upto - 1) * 7 // 700
    assert {r["bin"] for r in got} == set(data["bin"]) and len(got) == 3 * data["bin"].nunique()
    for r in got:
        part = data[data["bin"] == r["bin"]]
        assert (r["n"], r["start"]) == (len(part), part["l"].min())
        assert r["quantile"] == pytest.approx(np.quantile(part["u"], r["probability"]), abs=1e-12)
        assert r["share_below"] == pytest.approx((part["u"] < r["probability"]).mean())


def test_residual_checks_of_nothing(spark):
    empty = spark.createDataFrame([], "y int, l double, u double")
    assert residual_trend(empty, "l", "u").collect() == [] and residual_tests(empty, "y", "l", "u").collect() == []


def test_mixed_fit_is_stored_by_version(spark, tmp_path):
    path = str(tmp_path / "fit")
    with pytest.raises(FileNotFoundError):
        load_mixed_fit(spark, path)
    df = spark.createDataFrame(simulated(500))
    fit = fit_mixed_logit(df, "y", ["one", "x1", "x2"], ["year", "litter"], sds={"year": 0.4, "litter": 0.8})
    first = save_mixed_fit(spark, fit, path)
    fresh = spark.newSession()
    again = load_mixed_fit(fresh, path)
    assert again.names == fit.names and again.sds == fit.sds and again.aic == fit.aic
    assert (again.beta == fit.beta).all() and (again.covariance == fit.covariance).all()
    assert again.level_counts == fit.level_counts and (again.rows, again.passes) == (fit.rows, fit.passes)
    for g in ("year", "litter"):
        assert sorted(again.effects[g].collect()) == sorted(fit.effects[g].collect())
    second = save_mixed_fit(spark, dataclasses.replace(fit, beta=fit.beta + 1), path)
    (tmp_path / "fit" / "broken_off").mkdir()
    assert load_mixed_fit(fresh, path).beta[0] == fit.beta[0] + 1 and second != first
    assert load_mixed_fit(fresh, path, first).beta[0] == fit.beta[0]
    with pytest.raises(FileNotFoundError):
        load_mixed_fit(fresh, path, "broken_off")
    plain = dataclasses.replace(fit, sds={}, effects={}, level_counts={})
    save_mixed_fit(spark, plain, str(tmp_path / "plain"))
    assert load_mixed_fit(fresh, str(tmp_path / "plain")).effects == {}


@pytest.mark.parametrize("hot", [False, True])
def test_crossed_fit_above_the_driver_bound(spark, hot):
    """The largest factor is eliminated on the executors, its hot levels stay on the driver; the fit is the dense one."""
    data, sds = crossed_data(), {"dam": 0.8, "litter": 0.6}
    if hot:
        data.loc[::3, "litter"] = 7
    codes = data.assign(**{g: data[g].astype("category").cat.codes for g in sds})
    fit = fit_mixed_logit(
        spark.createDataFrame(data), "y", ["one", "x1", "x2"], list(sds), sds=sds, tolerance=1e-10, driver_levels=150)
    beta, covariance, deviance, u = dense_fit(codes, sds, list(sds))
    assert fit.beta == pytest.approx(beta, abs=1e-4)
    assert fit.covariance == pytest.approx(covariance, abs=1e-6)
    assert abs(fit.minus_two_loglik - deviance) < 4 * fit.deviance_error
    dams = codes["dam"].max() + 1
    for g, own in (("dam", u[:dams]), ("litter", u[dams:])):
        found = {int(r["level"]): r["effect"] for r in fit.effects[g].collect()}
        assert [found[i] for i in sorted(found)] == pytest.approx(own * sds[g], abs=1e-4)
        assert fit.level_counts[g] == len(found)


@pytest.mark.parametrize("level_rows", [1, 10**6])
def test_levels_beyond_the_driver_in_tasks_or_shuffled(spark, level_rows):
    """Above the driver's bound rows of whole outer levels lie in one task, unless a level is too large for one."""
    data, groups, sds = simulated(), ["year", "dam", "litter"], {"year": 0.4, "dam": 0.8, "litter": 0.6}
    problem = prepare(spark.createDataFrame(data), "y", ["one", "x1", "x2"], groups, 64, 10, level_rows)
    assert (problem.chunks is None) == (level_rows == 1) and not problem.driver_levels
    state, ahead = settle(problem, State(tuple(sds[g] for g in problem.factors), np.zeros(problem.size)), 1e-10)
    near = prepare(spark.createDataFrame(data), "y", ["one", "x1", "x2"], groups, 64, 10_000)
    told, _ = settle(near, State(state.sds, np.zeros(near.size)), 1e-10)
    assert state.objective == pytest.approx(told.objective, abs=1e-6) and ahead.dense == pytest.approx(told.dense, abs=1e-5)
    for mine, other in zip(gradient(problem, state), gradient(near, told)):
        assert mine == pytest.approx(other, abs=1e-4)


def test_mixed_fit_query_reads_lateness_suppliers_and_parts(spark, tmp_path):
    """The outcome and the levels are those of the tables, also where order keys say nothing."""
    rng, n = np.random.default_rng(3), 1500
    supplier, part, order = rng.integers(0, 8, n), rng.integers(0, 3, n), rng.integers(0, 700, n)
    eta = -0.3 + rng.normal(size=8)[supplier] + rng.normal(size=24)[supplier * 3 + part]
    late = rng.random(n) < 1 / (1 + np.exp(-eta))
    ordered = pd.to_datetime("1996-01-01") + pd.to_timedelta(rng.integers(0, 700, 700), "D")
    shipped = ordered[order] + pd.to_timedelta(np.where(late, 61, 60), "D")
    lines = pd.DataFrame(dict(
        l_orderkey=order * 500, l_partkey=part, l_suppkey=supplier, l_linenumber=1, l_quantity=rng.integers(1, 51, n) * 1.0,
        l_discount=rng.integers(0, 11, n) / 100, l_shipdate=shipped))
    spark.createDataFrame(lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = pd.DataFrame(dict(o_orderkey=np.arange(700) * 500, o_orderdate=ordered))
    spark.createDataFrame(pd.concat([orders, orders[:50]])).write.parquet(f"{tmp_path}/orders.parquet")
    found = {r["name"]: r["value"] for r in operators.g2_mixed(spark, str(tmp_path)).collect()}
    same = pd.DataFrame(dict(
        y=late * 1.0, one=1.0, quantity=lines["l_quantity"] / 50, discount=lines["l_discount"], season=shipped.month,
        supplier=supplier, part=supplier * 3 + part))
    fit = fit_mixed_logit(spark.createDataFrame(same), "y", ["one", "quantity", "discount"], ["season", "supplier", "part"])
    assert set(found) == {"constant", "quantity", "discount", "season", "supplier", "part"}
    assert [found[g] for g in fit.sds] == pytest.approx(list(fit.sds.values()), abs=1e-3)
    assert [found[c] for c in ("constant", "quantity", "discount")] == pytest.approx(fit.beta, abs=1e-3)
    assert found["supplier"] > 0.2 and found["part"] > 0.2


def stored_bytes(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_steps_above_the_driver_bound_do_not_pile_up(spark):
    """The rows are stored once; a step stores effects, and those of earlier steps are dropped."""
    data = simulated(20_000)
    problem = prepare(spark.createDataFrame(data), "y", ["one", "x1", "x2"], ["year", "dam", "litter"], 64, 10)
    state, sizes = State((0.4, 0.8, 0.6), np.zeros(problem.size)), []
    for _ in range(9):
        newton(problem, state)
        state = following(problem, state)
        sizes.append(stored_bytes(spark))
    assert sizes[-1] - sizes[2] < 20_000 * 8  # six steps; one copy of the rows has 44 bytes a row
    problem.close()
    assert stored_bytes(spark) < sizes[-1] - 20_000 * 20


def test_crossed_steps_above_the_driver_bound_do_not_pile_up(spark):
    """The rows are stored once; a step stores the effects of the eliminated factor, and earlier ones are dropped."""
    data = simulated(20_000)
    data["litter"] = (data["litter"] * 7 + data.index % 3) % data["litter"].nunique()
    problem = crossed.prepare_crossed(spark.createDataFrame(data), "y", ["one", "x1", "x2"], ["dam", "litter"], 150)
    held, sizes = None, []
    for _ in range(7):
        held = crossed.system_at(problem, [0.8, 0.6], np.zeros(problem.size), held).held
        sizes.append(stored_bytes(spark))
    assert problem.gone == 1 and sizes[-1] - sizes[2] < 20_000 * 8  # four steps; one copy of the rows has 52 bytes a row


@pytest.mark.parametrize("chunks", [None, "stored"])
def test_downhill_takes_the_same_moves_in_few_jobs(monkeypatch, chunks):
    """A long way along one axis costs a job per few rounds where a job is dear, and ends where the plain search does."""
    target, jobs, steps = np.array([-1.5, 0.4, -6.0]), [], [0.4]

    def bowl(logs):
        apart = np.asarray(logs) - target
        return float(apart @ [[3.0, 0.2, 0.0], [0.2, 5.0, 0.3], [0.0, 0.3, 0.05]] @ apart)

    def told(problem, state, candidates):
        jobs.append(len(candidates))
        return [bowl(np.log(c)) for c in candidates]

    best = list(np.log([0.5] * 3))
    while steps[-1] >= 0.02:
        step = steps[-1]
        tried = [[min(max(v + move * (f == k), laplace.LOW), laplace.HIGH) for k, v in enumerate(best)] for f in range(3) for move in (step, -step)]
        axes = [min(tried[2 * f : 2 * f + 2], key=bowl) for f in range(3)]
        tried.append([t[f] if bowl(best) - bowl(t) > 1e-9 else best[f] for f, t in enumerate(axes)])
        found = min(tried, key=bowl)
        steps.append(step if bowl(found) < bowl(best) - 1e-9 else step / 2)
        best = found if steps[-1] == step else best
    monkeypatch.setattr(laplace, "objectives_near", told)
    out = laplace._downhill(dataclasses.make_dataclass("Stub", ["chunks"])(chunks), State((0.5, 0.5, 0.5), np.zeros(1)))
    assert out == pytest.approx(best, abs=1e-12)
    plain_jobs = 1 + 2 * (len(steps) - 1)
    assert chunks is None or 3 * len(jobs) < plain_jobs


@pytest.mark.parametrize("groups", [["year"], ["year", "litter"], ["year", "dam", "litter"]])
def test_deviance_near_is_that_of_rescaled_lines(spark, groups):
    problem = prepare(spark.createDataFrame(simulated(400)), "y", ["one", "x1", "x2"], groups, 64, 10_000)
    state, _ = settle(problem, State((0.5,) * len(groups), np.zeros(problem.size)), 1e-6)
    system, asked, plain = state.system, [], []
    for sds in ([0.5] * 3, [0.3, 0.9, 0.5], [0.5, 0.5, 1.7], [0.8, 0.9, 0.001]):
        sds = sds[: len(groups)]
        asked.append((rule_of(problem, sds), laplace._ratios(problem, state.sds, sds), *laplace._scales(problem, state.sds, sds)))
        outer, block = asked[-1][0].inner_sums(rescaled_lines(system.lines, problem.size, *asked[-1][1:]))
        plain.append(block + asked[-1][0].outer_block(outer))
    assert isinstance(system, DriverLevels)
    assert np.stack(system.near(asked)) == pytest.approx(np.stack(plain), rel=1e-10, abs=1e-9)


def test_packed_scan_has_a_line_per_chunk_and_level(spark):
    """Rows whose levels the driver holds are packed once; their lines are those of the row-wise scan."""
    data, groups, sds = simulated(400), ["year", "dam", "litter"], {"year": 0.4, "dam": 0.8, "litter": 0.6}
    problem = prepare(spark.createDataFrame(data), "y", ["one", "x1", "x2"], groups, 64, 10_000)
    assert problem.packed.count() < 10  # records of many rows
    state = State(tuple(sds[g] for g in problem.factors), np.full(problem.size, 0.1))
    mine, rows_ = (f(problem, state).orderBy("kind", "i", "a").toPandas() for f in (_packed_scan, _scan))
    numbers = [c for c in mine if c.startswith("v")]
    assert mine[["kind", "i", "a", "b"]].fillna("").equals(rows_[["kind", "i", "a", "b"]].fillna(""))
    assert np.allclose(mine[numbers], rows_[numbers])


def test_residual_tests_read_the_rows_once(spark):
    met = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(v):
        met.add(1)
        return v

    data = spark.range(3000).selectExpr("cast(id % 2 as int) as y", "id / 1500 - 1 as link", "(id * 7 % 3000 + 0.5D) / 3000 as u")
    assert residual_tests(data.withColumn("u", seen("u")), "y", "link", "u").count() == 6
    assert met.value <= 6000  # the filter and the column may each call it


@pytest.mark.parametrize("rows_", [10**6, 5])
def test_uniformity_distance_between_the_ends_of_cells(spark, monkeypatch, rows_):
    """Exact for values that share a cell, tied or outside the range, and where a cell is too full to be ranked at once."""
    monkeypatch.setattr(ranking, "CELL_ROWS", rows_)
    rng = np.random.default_rng(3)
    for values in (rng.random(500)**3, rng.random(200) * 1e-6, np.r_[rng.random(50) * 3 - 1, [0.4] * 30], [0.25]):
        u = np.sort(values)
        i = np.arange(1, len(u) + 1)
        want = max((i / len(u) - u).max(), (u - (i - 1) / len(u)).max())
        found = ranking.uniformity_distance(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "u double"), "u").first()
        assert found["n"] == len(u) and found["ks"] == pytest.approx(want, abs=1e-12)
