"""Logistic regression with random intercepts, fitted by aggregates over the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.operators import crossed
from vitalrates.operators.laplace import HIGH, LOW, MOST_LOG, SDS_START, least_deviance, settle
from vitalrates.operators.mixed_system import LEVEL_ROWS, SMALL_LEVELS, NotNested, Placed, Problem, State, prepare
from vitalrates.session import LOOKUP_MAX_ROWS, cut_lineage, freed_shuffles


@dataclass
class MixedFit:
    """Fixed effects with their covariance, random-effect deviations and tables, and the deviance.

    With crossed factors the deviance is estimated; `deviance_error` is its standard error.
    """

    names: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    sds: dict[str, float]
    effects: dict[str, DataFrame]
    minus_two_loglik: float
    rows: int
    level_counts: dict[str, int]
    passes: int
    deviance_error: float = 0.0

    @property
    def aic(self) -> float:
        return self.minus_two_loglik + 2 * (len(self.beta) + len(self.sds))


def fit_mixed_logit(
    df: DataFrame,
    y: str,
    x: Sequence[str],
    groups: Sequence[str] = (),
    sds: dict[str, float] | None = None,
    tolerance: float = 1e-6,
    small_levels: int = SMALL_LEVELS,
    driver_levels: int = LOOKUP_MAX_ROWS,
    joint: bool = True,
    stop: float = 1e-3,
    level_rows: int = LEVEL_ROWS,
) -> MixedFit:
    """Fit y ~ x plus a random intercept per level of each group, by Laplace approximation.

    `df` must hold complete cases; `x` includes the constant column. Without `sds` the deviations and the fixed effects
    minimise the Laplace deviance together, until a step promises less than `stop` of it. Without `joint` only the
    deviations do, and as with given `sds` the fixed effects are at the joint mode with the random effects, which takes
    fewer scans and is close unless groups are nearly all alike. Factors of at most `small_levels` levels join the dense
    system; with more than `driver_levels` levels the elimination runs on the executors, by the same steps, in
    the tasks that hold the rows, or by shuffled lines where an outer level has more than `level_rows` rows. Larger
    factors that are not nested, or more than two of them, are fitted by conjugate gradients (module `crossed`), with the
    fixed effects at the joint mode; with more than `driver_levels` levels together the largest factor is eliminated on the
    executors, and the others may have `crossed.KEPT_LEVELS` levels.
    """
    if sds is not None and set(sds) != set(groups):
        raise ValueError(f"deviations given for {sorted(sds)}, factors are {sorted(groups)}")
    bound = min(driver_levels, LOOKUP_MAX_ROWS)
    with freed_shuffles(df.sparkSession):
        try:
            problem = prepare(df, y, x, groups, small_levels, bound, level_rows)
        except NotNested:
            return _crossed_fit(df, y, x, groups, sds, tolerance, stop, bound)
        return _nested_fit(problem, sds, tolerance, joint, stop)


def _nested_fit(problem: Problem, sds: dict[str, float] | None, tolerance: float, joint: bool, stop: float) -> MixedFit:
    try:
        begin = tuple((sds or {}).get(g, SDS_START) for g in problem.factors)
        state = State(begin, np.zeros(problem.size))
        searched = sds is None and problem.factors
        final, ahead = least_deviance(problem, state, tolerance, joint, stop) if searched else settle(problem, state, tolerance)
        return _result(problem, final, ahead)
    finally:
        problem.close()


def _crossed_fit(
    df: DataFrame, y: str, x: Sequence[str], groups: Sequence[str], sds: dict[str, float] | None, tolerance: float, stop: float,
    driver_levels: int,
) -> MixedFit:
    problem = crossed.prepare_crossed(df, y, x, groups, driver_levels)
    spark, p = df.sparkSession, len(problem.x)
    try:
        begin = [(sds or {}).get(g, SDS_START) for g in groups]
        if sds is None:
            begin, system = crossed.search(problem, begin, tolerance, max(stop, 1e-3), (LOW, HIGH), MOST_LOG)
        else:
            system = crossed.mode(problem, begin, np.zeros(problem.size), tolerance)
        value, error = crossed.deviance(problem, system)
        covariance = crossed.solve(system, np.eye(problem.size, p))[:p]
        effects = {
            g: spark.createDataFrame(
                [(v, float(u) * float(sd)) for v, u in zip(names, system.at[end - len(names):end])],
                "level string, effect double")
            for g, names, sd, end in zip(groups, problem.levels, begin, problem.ends[1:])
        }
        if problem.gone is not None:
            g = problem.factors[problem.gone]
            effects[g] = effects[g].union(cut_lineage(crossed.gone_effects(problem, system, float(begin[problem.gone]))))
        return MixedFit(
            problem.x, system.at[:p], (covariance + covariance.T) / 2, dict(zip(groups, map(float, begin))), effects, value,
            problem.n, dict(zip(groups, problem.counts)), problem.passes, error,
        )
    finally:
        problem.close()


def _result(problem: Problem, final: State, ahead: State) -> MixedFit:
    spark = problem.rows.sparkSession
    p = len(problem.x)
    sds = dict(zip(problem.factors, map(float, final.sds)))
    effects: dict[str, DataFrame] = {}
    at = p
    for g in problem.small:
        names = problem.small_levels[g]
        values = ahead.dense[at:at + len(names)] * sds[g]
        effects[g] = spark.createDataFrame(list(zip(names, map(float, values))), "level string, effect double")
        at += len(names)
    for g, table, key, value in zip(problem.nested, (ahead.levels, ahead.outer), "ab", ("ua", "ub")):
        if isinstance(table, Placed):
            table = cut_lineage(table.effects(key, value))
        elif isinstance(table, pd.DataFrame):
            table = spark.createDataFrame(table[[key, value]], f"{key} string, {value} double")
        effects[g] = table.select(F.col(key).alias("level"), (F.col(value) * sds[g]).alias("effect"))
    return MixedFit(
        problem.x, ahead.dense[:p], np.linalg.inv(final.schur)[:p, :p], sds, effects, final.objective, problem.n,
        problem.counts, problem.passes,
    )
