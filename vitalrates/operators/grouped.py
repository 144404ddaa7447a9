"""Per-group facts put back on the rows, always as a partial aggregate plus a join, never as a whole-group window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.functions.casting import divide
from vitalrates.operators.joins import attach_small, left_join


def zscore_within(
    df: DataFrame, groups: Sequence[str], columns: dict[str, str], hot: Sequence | None = None
) -> DataFrame:
    """Add (x - mean) / sd inside each group for `columns` {source: new name}.

    Missing values are ignored; a group with one value, or with equal values, gives NULL. Groups may be as large
    as the table: their means and deviations are partial aggregates of one row per group.
    """
    stats = df.groupBy(*groups).agg(*[
        f(F.col(c).cast("double")).alias(f"__{tag}_{c}") for c in columns for tag, f in (("mean", F.avg), ("sd", F.stddev_samp))
    ])
    joined = attach_small(df, stats, list(groups), hot=hot, spread_by=list(columns))
    return joined.withColumns({
        new: divide(F.col(c).cast("double") - F.col(f"__mean_{c}"), F.nullif(F.col(f"__sd_{c}"), F.lit(0.0)))
        for c, new in columns.items()
    }).select(*df.columns, *columns.values())


def standardise(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add whole-table z-scores for `columns` {source: new name}; the statistics are one row."""
    stats = df.agg(*[
        f(F.col(c).cast("double")).alias(f"{tag}_{c}") for c in columns for tag, f in (("mean", F.avg), ("sd", F.stddev_samp))
    ]).first()
    return df.withColumns({
        new: divide(F.col(c).cast("double") - F.lit(stats[f"mean_{c}"]), F.nullif(F.lit(stats[f"sd_{c}"]), F.lit(0.0)))
        for c, new in columns.items()
    })


def group_size(df: DataFrame, key: str, counted: str, name: str, hot: Sequence | None = None) -> DataFrame:
    """Rows with a non-NULL `key` and the number of non-NULL `counted` in their group."""
    sizes = df.groupBy(key).agg(F.count(counted).alias(name)).filter(F.col(key).isNotNull())
    return left_join(df, sizes, [key], null_safe=False, hot=hot, spread_by=[counted], how="inner")


def first_value(df: DataFrame, groups: Sequence[str], column: str, order: str) -> DataFrame:
    """One row per group with the value `column` has in the row with the smallest `order`."""
    return df.groupBy(*groups).agg(F.min_by(column, order).alias(column))


def keep_first_trials(
    df: DataFrame,
    groups: Sequence[str],
    years: Sequence[int],
    observer: str,
    order: str,
    hot: Sequence | None = None,
) -> DataFrame:
    """Drop repeat trials of the groups whose first row, in `years`, was taken by `observer`.

    In such a group only rows with trialnumber 1 stay; all other groups stay whole.
    """
    flagged = (
        first_value(df.filter(F.col("year").isin(list(years))), groups, "observer", order)
        .filter(F.col("observer") == observer)
        .select(*groups)
        .withColumn("__flagged", F.lit(True))
    )
    joined = left_join(df, flagged, list(groups), hot=hot, spread_by=[order])
    return joined.filter(F.col("__flagged").isNull() | (F.col("trialnumber") == 1)).drop("__flagged")
