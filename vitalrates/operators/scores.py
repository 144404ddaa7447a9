"""Principal-component scores appended to the rows they belong to."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.functions.casting import divide
from vitalrates.operators.ranking import exact_medians


@dataclass(frozen=True)
class Component:
    """First principal component of standardised columns."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    loadings: tuple[float, ...]
    variance: float


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(first, second, r) for every pair of columns, from one pass."""
    pairs = list(combinations(columns, 2))
    # A column without variance has no correlation: NULL, where corr itself would fail.
    both = {
        (a, b): (F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))) for a, b in pairs
    }
    row = df.agg(*[
        divide(
            F.covar_samp(x, y), F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0))
        ).alias(f"r{i}")
        for i, (x, y) in enumerate(both.values())
    ])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ])).alias("p")).select("p.*")


def first_components(df: DataFrame, sets: dict[str, Sequence[str]]) -> dict[str, Component]:
    """First component of each set of columns, all from one aggregate of means, deviations and covariances.

    The loading of largest size is positive. A column without variance raises.
    """
    columns = list(dict.fromkeys(c for s in sets.values() for c in s))
    pairs = list(dict.fromkeys(p for s in sets.values() for p in combinations(s, 2)))
    row = df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.stddev_samp(c).alias(f"sd_{c}") for c in columns],
        *[F.covar_samp(a, b).alias(f"c_{a}_{b}") for a, b in pairs],
    ).first()
    result = {}
    for name, members in sets.items():
        flat = [c for c in members if not row[f"sd_{c}"]]
        if flat:
            raise ValueError(f"columns without variance: {flat}")
        matrix = np.eye(len(members))
        for (i, a), (j, b) in combinations(list(enumerate(members)), 2):
            matrix[i, j] = matrix[j, i] = row[f"c_{a}_{b}"] / row[f"sd_{a}"] / row[f"sd_{b}"]
        values, vectors = np.linalg.eigh(matrix)
        loading = vectors[:, -1]
        lead = int(np.argmax(np.round(np.abs(loading), 9)))
        loading = loading * np.sign(loading[lead])
        result[name] = Component(
            tuple(members), tuple(row[f"mean_{c}"] for c in members), tuple(row[f"sd_{c}"] for c in members),
            tuple(float(v) for v in loading), float(values[-1]),
        )
    return result


def add_scores(df: DataFrame, sets: dict[str, Sequence[str]]) -> DataFrame:
    """`df` with one score column per set; missing values count as the exact median of their column.

    The score is a row expression over fitted constants, so no second table is bound to the rows.
    """
    columns = list(dict.fromkeys(c for s in sets.values() for c in s))
    medians = exact_medians(df, columns)

    def filled(c: str):
        return F.coalesce(F.col(c).cast("double"), F.lit(medians[c]))

    components = first_components(df.select(*[filled(c).alias(c) for c in columns]), sets)
    scores = {}
    for name, part in components.items():
        terms = [
            (filled(c) - m) / s * v
            for c, m, s, v in zip(part.columns, part.means, part.deviations, part.loadings)
        ]
        scores[name] = sum(terms[1:], terms[0])
    return df.withColumns(scores)
