"""Lasso paths for many bootstrap replicates from one scan of the rows."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Tasks carry the functions of this module, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def cross_products(df: DataFrame, x: Sequence[str], y: str, weights: str, center: Sequence[float]) -> DataFrame:
    """Weighted cross products of (1, x, y) per replicate, in the bag and out of it.

    Every task adds up its own rows and emits one small matrix per replicate, so the shuffle carries matrices only.
    One row per (rep, bag, i) with the i-th matrix row in `products`. `center` is subtracted from (x, y) first to keep
    the sums small.
    """
    columns = [*x, y]
    size = len(columns) + 1
    shift = np.asarray(center, dtype=float)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = None
        for pdf in batches:
            if not len(pdf):
                continue
            z = np.column_stack([np.ones(len(pdf)), pdf[columns].to_numpy(float) - shift])
            w = np.stack(pdf[weights].to_numpy()).astype(float)
            sums = np.zeros((w.shape[1], 2, size, size)) if sums is None else sums
            for rep in range(w.shape[1]):
                drawn = w[:, rep]
                sums[rep, 0] += z.T @ (z * drawn[:, None])
                left_out = z[drawn == 0]
                sums[rep, 1] += left_out.T @ left_out
        if sums is not None:
            reps, bags, rows = (a.ravel() for a in np.indices(sums.shape[:3]))
            yield pd.DataFrame({
                "rep": reps, "bag": bags, "i": rows, **{f"c{j}": sums[..., j].ravel() for j in range(size)}
            })

    schema = "rep int, bag int, i int, " + ", ".join(f"c{j} double" for j in range(size))
    parts = df.select(*columns, weights).mapInPandas(partial, schema)
    return parts.groupBy("rep", "bag", "i").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(size)]).select(
        "rep", "bag", "i", F.array(*[f"c{j}" for j in range(size)]).alias("products")
    )


def coordinate_descent(
    products: np.ndarray, penalties: Sequence[float], tolerance: float = 1e-8, rounds: int = 10_000
) -> np.ndarray:
    """(intercept, coefficients) per penalty from the cross products of (1, x, y).

    Minimises half the mean squared error plus the penalty times the absolute coefficients of the columns scaled to
    unit population deviation; a constant column gets 0.
    """
    n = products[0, 0]
    mean = products[0, 1:] / n
    cov = products[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0.0))
    used = sd > 1e-10
    scale = np.where(used, sd, 1.0)
    gram = cov[:-1, :-1] / np.outer(scale, scale)
    target = cov[:-1, -1] / scale
    limits = np.asarray(penalties, dtype=float)
    active = np.flatnonzero(used)
    # All penalties move together, starting from least squares, which is where the small ones end.
    b = np.zeros((len(sd), len(limits)))
    b[active] = np.linalg.lstsq(gram[np.ix_(active, active)], target[active], rcond=None)[0][:, None]
    unit = np.sqrt(max(cov[-1, -1], 1e-300))
    for _ in range(rounds):
        before = b.copy()
        for j in active:
            rho = target[j] - gram[j] @ b + gram[j, j] * b[j]
            b[j] = np.sign(rho) * np.maximum(np.abs(rho) - limits, 0.0) / gram[j, j]
        if np.abs(b - before).max(initial=0.0) < tolerance * unit:
            break
    else:
        raise RuntimeError(f"the coefficients still move after {rounds} rounds")
    slopes = (b / scale[:, None]).T
    return np.column_stack([mean[-1] - slopes @ mean[:-1], slopes])


def tuning_table(products: DataFrame, penalties: Sequence[float]) -> DataFrame:
    """(rep, penalty, n, sse): out-of-bag squared error of every penalty in every replicate.

    Each replicate is one group of a few hundred short rows; its error follows from the out-of-bag products alone.
    """
    grid = [float(p) for p in penalties]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        bags = {
            bag: np.stack(part.sort_values("i")["products"].to_numpy()) for bag, part in pdf.groupby("bag")
        }
        coefficients = coordinate_descent(bags[0], grid)
        signed = np.column_stack([-coefficients, np.ones(len(grid))])
        sse = np.einsum("ki,ij,kj->k", signed, bags[1], signed)
        return pd.DataFrame({
            "rep": int(pdf["rep"].iloc[0]), "penalty": grid, "n": bags[1][0, 0], "sse": np.maximum(sse, 0.0)
        })

    # A fixed number of partitions keeps adaptive execution from putting all replicates into one task.
    spread = products.repartition(64, "rep")
    return spread.groupBy("rep").applyInPandas(one, "rep int, penalty double, n double, sse double")


def penalty_scores(tuned: DataFrame) -> DataFrame:
    """(penalty, rmse): out-of-bag root mean squared error averaged over the replicates with rows out of the bag."""
    return tuned.groupBy("penalty").agg(F.avg(F.sqrt(F.try_divide("sse", "n"))).alias("rmse"))
