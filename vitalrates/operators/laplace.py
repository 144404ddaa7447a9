"""Minimum of the Laplace deviance of a mixed logit over its deviations and fixed effects together.

The random effects are at their mode throughout. Deviations are first placed by the deviance as the level lines of the
last scan see it, without scanning rows; then quasi-Newton steps with the exact gradient go to the joint minimum. The
gradient takes one more scan: through the working weights every row moves the log-determinant by its leverage, and one
adjoint solve with the level lines carries that to all parameters. The same steps are taken for any number of levels.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from vitalrates.operators.mixed_system import Placed, Problem, State, following, leverage_sums, newton, rule_of, solved

SDS_START, SDS_FLOOR, SDS_CEILING = 0.5, 1e-3, 20.0
LOW, HIGH = math.log(SDS_FLOOR), math.log(SDS_CEILING)
#: How far a quasi-Newton step may go: in log deviations, and in standard errors of the fixed effects.
MOST_LOG, MOST_ERRORS = 0.7, 3.0
#: Rounds of the search for which points are asked ahead.
MOST_AHEAD = 32


def settle(problem: Problem, state: State, tolerance: float, hold: bool = False, limit: int = 60) -> tuple[State, State]:
    """Newton steps until the decrement is small; returns the last scanned state and the one after it.

    A step that raises the penalised deviance is halved until it does not.
    """
    last, reach = None, 1.0
    for _ in range(limit):
        newton(problem, state, hold)
        worse = last is not None and not state.penalised <= last.penalised + 1e-9 * abs(last.penalised)
        if worse and reach > 1e-6:
            reach /= 2
            state = following(problem, last, reach)
            continue
        if not math.isfinite(state.objective):
            raise ArithmeticError("the logistic fit diverged")
        if state.decrement < tolerance:
            return state, following(problem, state)
        last, reach = state, 1.0
        state = following(problem, state)
    raise ArithmeticError(f"no convergence in {limit} Newton steps")


def _scales(problem: Problem, old: Sequence[float], new: Sequence[float]) -> tuple[float, float]:
    """Old over new deviation of the inner and the outer factor."""
    a, b = dict(zip(problem.factors, old)), dict(zip(problem.factors, new))
    return tuple(([a[g] / b[g] for g in problem.nested] + [1.0, 1.0])[:2])


def _ratios(problem: Problem, old: Sequence[float], new: Sequence[float]) -> np.ndarray:
    """New over old deviation for every dense column; 1 for the fixed effects."""
    out = [np.ones(len(problem.x))]
    for g, a, b in zip(problem.small, old, new):
        out.append(np.full(len(problem.small_levels[g]), b / a))
    return np.concatenate(out)


def objectives_near(problem: Problem, state: State, candidates: list[Sequence[float]]) -> list[float]:
    """Laplace deviance at other deviations from the scan made at `state`, without another scan.

    Effects on the scale of the outcome stay, so the scanned products only change scale; the working weights are
    those of the scan.
    """
    asked = []
    for sds in candidates:
        asked.append((rule_of(problem, sds), _ratios(problem, state.sds, sds), *_scales(problem, state.sds, sds)))
    blocks = state.system.near(asked)
    return [solved(problem, state.dense / ratios, block)[3] for (_, ratios, *_), block in zip(asked, blocks)]


def rescaled(problem: Problem, state: State, sds: Sequence[float], beta: np.ndarray | None = None) -> State:
    """The same random effects under other deviations (and other fixed effects), as a start for the next search."""
    dense = state.dense / _ratios(problem, state.sds, sds)
    if beta is not None:
        dense[: len(problem.x)] = beta
    levels = state.levels
    if levels is not None:
        first, second = _scales(problem, state.sds, sds)
        if isinstance(levels, Placed):
            levels = levels.scaled(first, second)
        elif isinstance(levels, pd.DataFrame):
            levels = levels.assign(ua=levels["ua"] * first, ub=levels["ub"] * second)
        else:
            levels = levels.withColumns({"ua": F.col("ua") * first, "ub": F.col("ub") * second})
    return State(tuple(sds), dense, levels)


def _moved(at: Sequence[float], step: float, signs: Sequence[int]) -> tuple[float, ...]:
    return tuple(min(max(v + step * sign, LOW), HIGH) for v, sign in zip(at, signs))


def _downhill(problem: Problem, seen: State, step: float = 0.4, stop: float = 0.02) -> list[float]:
    """Log deviations with the smallest deviance as the last scan sees it, by moves along the axes with shrinking steps.

    All moves of a round are asked at once, so that the level lines are read once a round. Where asking takes a job, the
    points that the next rounds may need are asked along: moves of several axes, smaller steps, and the last move repeated as
    often as it was taken so far, as the search runs straight for long. The moves that are taken do not depend on that.
    """
    factors = len(seen.sds)
    signs = [tuple(sign * (f == k) for k in range(factors)) for f in range(factors) for sign in (1, -1)]
    corners = [c for c in product((0, 1, -1), repeat=factors) if any(c)] if factors <= 3 else []
    known: dict[tuple[float, ...], float] = {}

    def values(points: list[tuple[float, ...]], along: list[tuple[float, ...]] = ()) -> list[float]:
        if any(t not in known for t in points):
            asked = [t for t in dict.fromkeys([*points, *along]) if t not in known]
            known.update(zip(asked, objectives_near(problem, seen, [[math.exp(v) for v in t] for t in asked])))
        return [known[t] for t in points]

    def guesses() -> list[tuple[float, ...]]:
        if problem.chunks is None:
            return []
        out = [_moved(best, step, c) for c in corners]
        out += [_moved(best, step / shrunk, c) for shrunk in (2, 4) if step / shrunk >= stop for c in signs]
        at = best
        for _ in range(min(run, MOST_AHEAD)):
            at = _moved(at, step, last)
            out += [_moved(at, step, c) for c in signs]
        return out

    best, last, run = tuple(math.log(v) for v in seen.sds), None, 0
    value = values([best], [*(_moved(best, step, c) for c in signs), *guesses()])[0]
    while step >= stop:
        tried = [_moved(best, step, c) for c in signs]
        found = values(tried, guesses())
        # Axes that gain are moved together when that gains more than the best one alone.
        gains = [max((value - found[2 * f + s], s) for s in (0, 1)) for f in range(factors)]
        together = tuple((1, -1)[s] if gain > 1e-9 else 0 for gain, s in gains)
        tried.append(_moved(best, step, together))
        found += values(tried[-1:])
        at = int(np.argmin(found))
        if found[at] < value - 1e-9:
            move = [*signs, together][at]
            last, run = move, run + 1 if move == last else 1
            best, value = tried[at], found[at]
        else:
            step, run = step / 2, 0
    return list(best)


def gradient(problem: Problem, state: State, joint: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the Laplace deviance by the fixed effects and by the log deviations, at a settled state.

    With `joint` the fixed effects follow the deviations at the joint mode with the random effects: the first part is then
    empty and the second a total derivative.
    """
    p, size, system = len(problem.x), problem.size, state.system
    inverse = np.linalg.inv(state.schur[p:, p:]) if size > p else np.zeros((0, 0))
    if problem.nested:
        table, *traces = system.leverage(p, inverse)
    else:
        table = pd.DataFrame([[""] + [0.0] * (2 + size - p)], columns=["a", "off", "v0", *[f"q{j}" for j in range(size - p)]])
    sums, by_level = leverage_sums(problem, state, table, inverse)
    # The adjoint solve leaves out the fixed columns where they are held, and has them as free columns where they follow.
    q = 0 if joint else p
    solver = np.linalg.inv(state.schur) if joint else inverse
    if problem.nested:
        v, inner, outer = system.adjoint(by_level, sums[q:], q, solver)
    else:
        v, inner, outer = solver @ sums[q:], np.zeros(q + 2), np.zeros(q + 2)
    fixed = -2.0 * system.raw[:q, size] + sums[:q] - system.raw[:q, q:size] @ v - inner[:q] - outer[:q]
    slopes, at = [], p
    for g in problem.small:
        own = slice(at, at + len(problem.small_levels[g]))
        u, kept = state.dense[own], slice(own.start - p, own.stop - p)
        slopes.append(2.0 * (problem.counts[g] - np.trace(inverse[kept, kept]) - u @ u + v[own.start - q : own.stop - q] @ u))
        at = own.stop
    for g, told, trace in zip(problem.nested, (inner, outer), traces if problem.nested else ()):
        slopes.append(2.0 * (problem.counts[g] - trace - told[q + 1] + told[q]))
    return fixed, np.array(slopes)


def _growth(logs: np.ndarray) -> tuple[float, np.ndarray]:
    """How far random intercepts stretch the fixed effects, and the derivative of its logarithm by the log deviations."""
    share = 3.0 / math.pi**2 * np.exp(2.0 * logs)  # against the variance of the logistic distribution
    growth = math.sqrt(1.0 + share.sum())
    return growth, share / growth**2


def _bent(b: np.ndarray, s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The curvature after a step s that changed the gradient by y, damped so that it stays positive."""
    bs, sbs = b @ s, s @ b @ s
    if s @ y < 0.2 * sbs:
        mixed = 0.8 * sbs / (sbs - s @ y)
        y = mixed * y + (1.0 - mixed) * bs
    return b - np.outer(bs, bs) / sbs + np.outer(y, y) / (s @ y)


def _minimum(problem: Problem, seen: State, ahead: State, x, curvature, place, slope, settled, stop: float, rounds: int):
    """Quasi-Newton steps over x, whose last entries are log deviations; `place` gives the deviations and fixed effects of
    an x, `settled` the state at its mode from a start, `slope` its derivatives by x."""
    factors = len(problem.factors)
    p, g = len(x) - factors, slope(seen)
    for _ in range(rounds):
        ends = np.concatenate([np.zeros(p, bool), ((x[p:] <= LOW + 1e-9) & (g[p:] > 0)) | ((x[p:] >= HIGH - 1e-9) & (g[p:] < 0))])
        step, free = np.zeros(len(x)), ~ends
        step[free] = -np.linalg.solve(curvature[np.ix_(free, free)], g[free])
        longest = max(np.abs(step[p:]).max(initial=0.0) / MOST_LOG, np.abs(step[:p]).max(initial=0.0) / MOST_ERRORS)
        step /= max(1.0, longest)
        promised, reach = -float(g @ step), 1.0
        if promised / 2 < stop:
            break
        while True:
            tried = x + reach * step
            tried[p:] = np.clip(tried[p:], LOW, HIGH)
            try:
                found, next_ = settled(rescaled(problem, ahead, *place(tried)))
                if found.objective <= seen.objective - 1e-4 * reach * promised:
                    break
                reach /= 2
            except ArithmeticError:  # too far: the effects do not settle there
                reach /= 4
            if reach < 1e-3:  # nothing gained along a descent direction: what is left is rounding
                return seen, ahead, curvature
        after, gained = slope(found), seen.objective - found.objective
        curvature = _bent(curvature, tried - x, after - g)
        x, g, seen, ahead = tried, after, found, next_
        if gained < stop and promised / 2 < 100 * stop:
            break
    else:
        raise RuntimeError(f"the deviance still falls after {rounds} steps")
    return seen, ahead, curvature


def least_deviance(
    problem: Problem, start: State, tolerance: float, joint: bool = True, stop: float = 1e-3, rounds: int = 100
) -> tuple[State, State]:
    """The settled state of the smallest Laplace deviance, and the state after it.

    First the deviations alone move, with the fixed effects at the joint mode with the random effects; with `joint` all
    parameters move from there.
    `stop` is the decrease of the deviance that a further step may still promise. `tolerance` is the Newton decrement up to
    which the effects are brought to their mode; the log-determinant moves with the root of it, so it is held small.
    """
    tolerance = min(tolerance, 1e-10)
    seen, ahead = settle(problem, start, 0.1)
    for _ in range(4):
        target = _downhill(problem, seen)
        moved = max(abs(a - math.log(b)) for a, b in zip(target, seen.sds))
        seen, ahead = settle(problem, rescaled(problem, ahead, [math.exp(v) for v in target]), 0.1)
        if moved < 0.1:
            break
    p, factors, bend = len(problem.x), len(problem.factors), 0.3
    seen, ahead = settle(problem, ahead, tolerance)
    logs = np.log(seen.sds)
    around = [[math.exp(v + d * (k == f)) for k, v in enumerate(logs)] for f in range(factors) for d in (bend, -bend)]
    told = objectives_near(problem, seen, [seen.sds, *around])
    curves = [max((told[1 + 2 * f] - 2 * told[0] + told[2 + 2 * f]) / bend**2, 0.5) for f in range(factors)]
    deviations = lambda x: [math.exp(v) for v in x[-factors:]]
    seen, ahead, curvature = _minimum(
        problem, seen, ahead, logs, np.diag(curves), lambda x: (deviations(x),), lambda s: gradient(problem, s, joint=True)[1],
        lambda s: settle(problem, s, tolerance), max(stop, 0.1) if joint else stop, rounds)
    if not joint:
        return seen, ahead

    # Fixed effects grow with the deviations as the logistic curve flattens; in units of that growth they hardly depend on
    # them, and in standard errors they are alike.
    logs = np.log(seen.sds)
    grown = _growth(logs)[0]
    centre, spread = seen.dense[:p] / grown, np.linalg.cholesky(np.linalg.inv(seen.schur)[:p, :p]) / grown

    def place(x: np.ndarray) -> tuple[list[float], np.ndarray]:
        return deviations(x), _growth(x[p:])[0] * (centre + spread @ x[:p])

    def slope(state: State) -> np.ndarray:
        fixed, random = gradient(problem, state)
        growth, by_log = _growth(np.log(state.sds))
        return np.concatenate([growth * (spread.T @ fixed), random + (fixed @ state.dense[:p]) * by_log])

    start = np.zeros((p + factors, p + factors))
    start[:p, :p], start[p:, p:] = 2.0 * np.eye(p), curvature
    seen, ahead, _ = _minimum(
        problem, seen, ahead, np.concatenate([np.zeros(p), logs]), start, place, slope,
        lambda s: settle(problem, s, tolerance, hold=True), stop, rounds)
    return seen, ahead
