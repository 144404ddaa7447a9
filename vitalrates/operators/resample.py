"""Reproducible splits and bootstrap weights, both functions of a row key.

Draws are the leading bits of an md5 of the key and its salts, so any engine can recompute them.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from decimal import Decimal, localcontext
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalrates.session import cut_lineage

# Tasks carry the functions of this module, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 52
STEPS = 1 << BITS
TIER_BITS = 10
LEAF_ROWS = 4096


def _steps(keys: Sequence[str], *salt: int | Column) -> Column:
    """Evenly spread whole number in [0, STEPS) per row key and salt; a NULL key counts as the text \\N."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\\N")) for k in keys]
    salts = [(s if isinstance(s, Column) else F.lit(s)).cast("string") for s in salt]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts, *salts)), 1, BITS // 4), 16, 10).cast("long")


def train_test_split(
    df: DataFrame, keys: Sequence[str], share: float = 0.8, seed: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Two disjoint tables that cover `df`; where a row goes depends on its key and the seed alone."""
    train = _steps(keys, seed) < F.lit(int(share * STEPS))
    return df.filter(train), df.filter(~train)


def poisson_limits(steps: int) -> list[int]:
    """Where a draw from [0, steps) reaches weight 1, 2, ... of Poisson(1): every weight that has a step of its own."""
    with localcontext(prec=60):
        total = term = Decimal(-1).exp()
        limits, k = [], 0
        while (limit := int(total * steps)) < steps - 1 or not limits:
            limits.append(limit)
            k += 1
            term /= k
            total += term
    return limits


def bootstrap_weights(
    df: DataFrame, keys: Sequence[str], times: int = 25, seed: int = 1, name: str = "weights"
) -> DataFrame:
    """Add an array with one Poisson(1) weight per replicate; weight 0 means out of bag.

    A weight stands for how often a row is drawn, so replicates need no copies of the rows. Independent Poisson
    weights stand in for drawing exactly as many rows as there are; `exact_bootstrap` draws those.
    """
    limits = poisson_limits(STEPS)

    draws = F.transform(
        F.sequence(F.lit(0), F.lit(times - 1)),
        lambda rep: _steps(keys, seed, rep),
    )
    weights = F.transform(draws, lambda u: reduce(lambda a, b: a + b, [(u >= F.lit(x)).cast("int") for x in limits]))
    return df.withColumn(name, weights)


def _shared_out(draws: np.ndarray, sizes: np.ndarray, seed: int, bits: int, node: int) -> np.ndarray:
    """(rep, child): the draws of a node given to its children by a chain of binomials, seeded by node and replicate."""
    shares = sizes / sizes.sum()
    return np.stack([
        np.random.default_rng([seed, rep, bits, node]).multinomial(int(k), shares) for rep, k in enumerate(draws)
    ])


def _splitter(seed: int, bits: int):
    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("child")
        parts = _shared_out(np.asarray(pdf["draws"].iloc[0]), pdf["m"].to_numpy(float), seed, bits, int(pdf["node"].iloc[0]))
        return pd.DataFrame({"node": pdf["child"].to_numpy(), "draws": list(parts.T)})

    return split


def exact_bootstrap(
    df: DataFrame, keys: Sequence[str], times: int = 25, seed: int = 1, name: str = "weights", leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """Add an array with one weight per replicate; in each, the weights of the n rows sum to exactly n.

    `keys` identify the rows (a repeated key raises while the rows are read); an empty table stays empty. Rows are
    placed by a hash of their key in ranges of about `leaf_rows`. From the counts of the ranges the n draws of a
    replicate are split down a tree, each node among at most 1,024 children, each range among its rows. Splits are
    seeded by node, so the weights do not depend on the partitioning, and no task sees more than the children of one
    node or one range. The rows are shuffled by range and by place; all else is one line per range.
    """
    spark, n = df.sparkSession, df.count()
    bits = max(0, math.ceil(math.log2(max(n, 1) / leaf_rows)))
    placed = df.withColumn("__at", _steps(keys, seed)).withColumn("__leaf", F.shiftright("__at", BITS - bits))
    sizes = cut_lineage(placed.groupBy("__leaf").agg(F.count("*").alias("m")))
    node = spark.createDataFrame([(0, [n] * times)], "node bigint, draws array<bigint>")
    above = 0
    while above < bits:
        below = min(above + TIER_BITS, bits)
        children = sizes.groupBy(F.shiftright("__leaf", bits - below).alias("child")).agg(F.sum("m").alias("m"))
        children = children.withColumn("node", F.shiftright("child", below - above))
        split = _splitter(seed, below)
        node = children.join(node, "node").groupBy("node").applyInPandas(split, "node bigint, draws array<bigint>")
        above = below
        if above < bits:
            node = cut_lineage(node)

    def deal(batches):
        for pdf in batches:
            for leaf, m, draws in zip(pdf["__leaf"], pdf["m"], pdf["draws"]):
                if m > 4 * leaf_rows + 64:  # far beyond what different keys can bring together
                    raise ValueError(f"{m} rows share a range made for {leaf_rows}: a value of {list(keys)} repeats")
                parts = _shared_out(np.asarray(draws), np.ones(int(m)), seed, BITS + 1, int(leaf))
                yield pd.DataFrame({"__leaf": leaf, "__place": np.arange(1, int(m) + 1), name: list(parts.T.astype("int32"))})

    leaves = sizes.join(node, sizes["__leaf"] == node["node"]).select("__leaf", "m", "draws")
    weights = leaves.mapInPandas(deal, f"__leaf bigint, __place int, `{name}` array<int>")
    order = Window.partitionBy("__leaf").orderBy("__at", *keys)
    row_key = F.struct("__at", *keys)
    repeated = F.lag(row_key).over(order).eqNullSafe(row_key)
    place = F.when(repeated, F.raise_error(F.lit(f"rows repeat a value of {list(keys)}")).cast("int")).otherwise(
        F.row_number().over(order))
    return placed.withColumn("__place", place).join(weights, ["__leaf", "__place"]).select(*df.columns, name)
