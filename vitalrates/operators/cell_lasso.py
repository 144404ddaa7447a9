"""Lasso over numbers, two factors and their products from sums by cell, a cell being one pair of levels.

Dummies and products of two factors are constant within a cell, so the counts, sums and cross products of the numbers by cell
hold all that the normal equations need. Nothing here grows with the number of columns squared: a replicate takes one short
line per cell that occurs, and a round of the descent passes over the cells a few times.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tasks carry the functions of this module, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HISTORY = 6

def cell_products(
    df: DataFrame, x: Sequence[str], y: str, cell: tuple[str, str], weights: str, center: Sequence[float]
) -> DataFrame:
    """(rep, bag, first, second, products): weighted sums per replicate and cell, in the bag (0) and out of it (1).

    `products` is the upper triangle of the cross products of (1, x, y) by rows; `center` is subtracted from (x, y) first
    to keep the sums small. `cell` names two columns of level numbers.
    """
    shifted = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip([*x, y], center)]
    names = [f"z{i}" for i in range(len(shifted) + 1)]
    each = df.select(
        *[F.col(c).cast("int").alias(n) for c, n in zip(cell, ("first", "second"))],
        *[z.alias(n) for z, n in zip([F.lit(1.0), *shifted], names)], F.posexplode(weights).alias("rep", "drawn"),
    )
    times = F.when(F.col("drawn") > 0, F.col("drawn")).otherwise(F.lit(1)).cast("double")
    sums = [F.sum(times * F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    summed = each.groupBy("rep", (F.col("drawn") == 0).cast("int").alias("bag"), "first", "second").agg(
        *[s.alias(f"s{k}") for k, s in enumerate(sums)]
    )
    products = F.array(*[f"s{k}" for k in range(len(sums))])
    return summed.select("rep", "bag", "first", "second", products.alias("products"))


@dataclass
class Cells:
    """Sums by cell: level numbers (0 is the base level), rows, sums of numbers and outcome, pooled cross products."""

    first: np.ndarray
    second: np.ndarray
    n: np.ndarray
    x: np.ndarray
    y: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    @classmethod
    def of(cls, first: Sequence[int], second: Sequence[int], products: Sequence[Sequence[float]], numbers: int) -> Cells:
        size = numbers + 2
        rows = np.asarray(products, dtype=float).reshape(len(first), size * (size + 1) // 2)
        at = np.zeros((size, size), dtype=int)
        at[np.triu_indices(size)] = np.arange(rows.shape[1])
        pooled = rows.sum(axis=0)[at]
        return cls(
            np.asarray(first, dtype=int), np.asarray(second, dtype=int), rows[:, 0], rows[:, 1 : size - 1],
            rows[:, size - 1], pooled[1:-1, 1:-1] + np.triu(pooled[1:-1, 1:-1], 1).T - np.tril(pooled[1:-1, 1:-1], -1),
            pooled[1:-1, -1], float(pooled[-1, -1]),
        )


@dataclass
class Coefficients:
    """One fit: intercept, slopes, effects of the levels and of the cells that were fitted on."""

    intercept: float
    slopes: np.ndarray
    first: np.ndarray
    second: np.ndarray
    cells: dict[tuple[int, int], float]

    def offsets(self, cells: Cells) -> np.ndarray:
        """Prediction less the numbers' part in every cell; cells and levels that were not fitted on add nothing."""
        def effect(effects: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(at < len(effects), effects[np.minimum(at, len(effects) - 1)], 0.0)

        own = [self.cells.get(pair, 0.0) for pair in zip(cells.first.tolist(), cells.second.tolist())]
        return self.intercept + effect(self.first, cells.first) + effect(self.second, cells.second) + np.asarray(own)

    def squared_error(self, cells: Cells) -> float:
        o, b = self.offsets(cells), self.slopes
        error = cells.yy - 2 * o @ cells.y + cells.n @ o**2 + 2 * (o @ cells.x) @ b - 2 * cells.xy @ b + b @ cells.xx @ b
        return max(float(error), 0.0)


class _Descent:
    """Rounds of block coordinate descent on the coefficients (intercept, slopes, first, second, cells), kept as one vector."""

    def __init__(self, cells: Cells):
        self.cells, self.total = cells, cells.n.sum()
        self.places = [cells.first, cells.second, np.arange(len(cells.n))]
        levels = [np.bincount(at, cells.n) for at in self.places[:2]]
        levels[0][0] = levels[1][0] = 0.0  # the base levels have no column
        counts = [*levels, np.where((cells.first > 0) & (cells.second > 0), cells.n, 0.0)]
        self.share = [c / self.total for c in counts]
        self.scale = [np.sqrt(np.maximum(s * (1 - s), 0.0)) for s in self.share]
        self.used = [s > 1e-10 for s in self.scale]
        mean = cells.x.sum(axis=0) / self.total
        self.spread = np.sqrt(np.maximum(np.diag(cells.xx) / self.total - mean**2, 0.0))
        self.numbers = np.flatnonzero(self.spread > 1e-10)
        ends = np.cumsum([1, len(mean), *map(len, counts)])
        self.slices = [slice(a, b) for a, b in zip(ends, ends[1:])]  # slopes and the three blocks
        self.weight = np.concatenate([[0.0], self.spread, *self.scale])
        self.unit = np.sqrt(max(cells.yy / self.total - (cells.y.sum() / self.total) ** 2, 1e-300))
        self.set(np.zeros(ends[-1]))

    def set(self, b: np.ndarray) -> None:
        """Take over coefficients; `left` are the sums of the residuals by cell."""
        self.b = b.copy()
        self.slopes, *self.effects = [self.b[s] for s in self.slices]
        self.offset = self.b[0] + sum(e[at] for e, at in zip(self.effects, self.places))
        self.left = self.cells.y - self.cells.n * self.offset - self.cells.x @ self.slopes

    def objective(self, penalty: float) -> float:
        """What is minimised, from the residual sums that `set` or a round left."""
        c, b = self.cells, self.slopes
        pulled = c.xy - self.offset @ c.x
        error = c.yy - self.offset @ c.y - self.offset @ (self.left + c.x @ b) - 2 * pulled @ b + b @ c.xx @ b
        return float(error / (2 * self.total) + penalty * self.weight @ np.abs(self.b))

    def round(self, penalty: float) -> float:
        """One pass over all coefficients; returns the largest change in units of the prediction."""
        c, moved = self.cells, 0.0
        for k, at in enumerate(self.places):
            step = self.left.sum() / self.total
            self.b[0] += step
            self.offset += step
            self.left -= c.n * step
            effects, share = self.effects[k], self.share[k]
            sums = self.left if k == 2 else np.bincount(at, self.left)
            pull = sums / self.total + share * effects
            size = np.maximum(np.abs(pull) - penalty * self.scale[k], 0.0)
            change = np.where(self.used[k], np.sign(pull) * size / np.where(self.used[k], share, 1.0), 0.0) - effects
            effects += change
            moved = max(moved, abs(step), np.max(np.abs(change) * self.scale[k], initial=0.0))
            self.offset += change[at]
            self.left -= c.n * change[at]
        for j in self.numbers:
            own = c.xx[j, j] / self.total
            pull = (c.xy[j] - c.x[:, j] @ self.offset - c.xx[j] @ self.slopes) / self.total + own * self.slopes[j]
            change = np.sign(pull) * max(abs(pull) - penalty * self.spread[j], 0.0) / own - self.slopes[j]
            self.slopes[j] += change
            moved = max(moved, abs(change) * self.spread[j])
            self.left -= c.x[:, j] * change
        return moved

    def leap(self, trail: list[np.ndarray], penalty: float) -> None:
        """Go on from the last rounds: to their combination with the least change, then along their common direction.

        The second helps where cells are missing: columns are then collinear, and rounds drift by equal small steps towards
        the least coefficients. Each move is kept only if it lowers the objective.
        """
        best, least = self.b.copy(), self.objective(penalty)

        def lower(b: np.ndarray) -> bool:
            nonlocal best, least
            self.set(b)
            reached = self.objective(penalty)
            if not reached < least:
                return False
            best, least = self.b.copy(), reached
            return True

        steps = np.diff(np.stack(trail), axis=0)
        scaled = steps * np.where(self.weight > 0, self.weight, 1.0)
        gram = scaled @ scaled.T
        mix = np.linalg.lstsq(gram / max(np.trace(gram), 1e-300), np.ones(len(gram)), rcond=1e-12)[0]
        if abs(mix.sum()) > 1e-12:
            lower(mix / mix.sum() @ np.stack(trail[1:]))
        length = 2.0
        while lower(best + length * steps[-1]):
            length *= 2.0
        self.set(best)


def cell_descent(cells: Cells, penalties: Sequence[float], tolerance: float = 1e-10, rounds: int = 50_000) -> list[Coefficients]:
    """A fit per penalty: half the mean squared error plus the penalty times the absolute coefficients of scaled columns.

    Columns are scaled by their population deviations; constant ones get 0. Penalties are taken from the largest down, each
    from the end of the one before. The dummies of one factor share no rows and neither do the products, so each of these
    blocks moves as a whole, after the intercept; the numbers follow one by one. Every few rounds are extrapolated
    (Anderson acceleration).
    """
    work, fits = _Descent(cells), {}
    for penalty in sorted({float(p) for p in penalties}, reverse=True):
        trail = [work.b.copy()]
        for _ in range(rounds):
            if work.round(penalty) < tolerance * work.unit:
                break
            trail.append(work.b.copy())
            if len(trail) > HISTORY:
                work.leap(trail, penalty)
                trail = [work.b.copy()]
        else:
            raise RuntimeError(f"the coefficients still move after {rounds} rounds")
        inside = np.flatnonzero(work.effects[2])
        pairs = zip(cells.first[inside].tolist(), cells.second[inside].tolist())
        fits[penalty] = Coefficients(
            float(work.b[0]), work.slopes.copy(), work.effects[0].copy(), work.effects[1].copy(),
            dict(zip(pairs, work.effects[2][inside].tolist())),
        )
    return [fits[float(p)] for p in penalties]


def cell_tuning_table(products: DataFrame, penalties: Sequence[float], numbers: int) -> DataFrame:
    """(rep, penalty, n, sse): out-of-bag squared error of every penalty in every replicate, from its lines by cell.

    A replicate with nothing in the bag or nothing out of it has n = 0.
    """
    grid = [float(p) for p in penalties]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["bag", "first", "second"])
        bags = [
            Cells.of(part["first"], part["second"], part["products"].tolist(), numbers)
            for part in (ordered[ordered["bag"] == bag] for bag in (0, 1))
        ]
        full = all(len(b.n) for b in bags)
        sse = [f.squared_error(bags[1]) for f in cell_descent(bags[0], grid)] if full else [0.0] * len(grid)
        return pd.DataFrame({
            "rep": int(pdf["rep"].iloc[0]), "penalty": grid, "n": bags[1].n.sum() if full else 0.0, "sse": sse
        })

    # A fixed number of partitions keeps adaptive execution from putting all replicates into one task.
    spread = products.repartition(64, "rep")
    return spread.groupBy("rep").applyInPandas(one, "rep int, penalty double, n double, sse double")
