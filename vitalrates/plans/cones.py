"""Cone crop by grid and year."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalrates.functions.casting import to_unsigned
from vitalrates.rules import (
    CONE_FIRST_YEAR, CONE_GRIDS, CONE_OFFSET, CONE_POWER, CONE_SCALE, CONE_SHIFT, FEEDING, MAST_YEARS,
)


def cone_index(count: Column) -> Column:
    return F.log(count.cast("double") + 1)


def total_cones(count: Column) -> Column:
    """Cones on a tree estimated from the count on one side."""
    return F.lit(CONE_SCALE) * F.exp(F.lit(CONE_SHIFT) + F.lit(CONE_POWER) * F.log(count.cast("double") + CONE_OFFSET))


def is_fed(grid: Column, year: Column, feeding: Sequence[tuple[str, int, int]] = FEEDING) -> Column:
    return reduce(lambda a, b: a | b, [(grid == g) & year.between(first, last) for g, first, last in feeding])


def cone_counts(
    cones: DataFrame,
    mast_years: Sequence[int] = MAST_YEARS,
    feeding: Sequence[tuple[str, int, int]] = FEEDING,
    grids: Sequence[str] = CONE_GRIDS,
    first_year: int = CONE_FIRST_YEAR,
    with_total: bool = False,
) -> DataFrame:
    """(year, grid, num_trees, cone_counts, cone_index, mast, exp, exp_label) of the surveyed grids.

    Grid names are compared and shown in upper case. `num_trees` is the sum of the counts. `with_total` adds the mean estimated cones per tree.
    """
    count = to_unsigned(F.col("numnew"))
    measures = [
        F.sum(count).alias("num_trees"), F.avg(count.cast("double")).alias("cone_counts"),
        F.avg(cone_index(F.col("numnew"))).alias("cone_index"),
    ]
    if with_total:
        measures.append(F.avg(total_cones(F.col("numnew"))).alias("total_cones"))
    grouped = (
        cones.filter(F.upper("grid").isin(list(grids)) & (F.col("year") >= first_year))
        .groupBy(F.col("year").alias("year"), F.upper("grid").alias("grid")).agg(*measures)
    )
    experiment = F.when(is_fed(F.col("grid"), F.col("year"), feeding), "f").otherwise("c")
    return grouped.withColumns({
        "mast": F.when(F.col("year").isin(list(mast_years)), 1).otherwise(0),
        "exp": experiment,
    }).withColumn("exp_label", F.when(F.col("exp") == "f", 19).otherwise(1))
