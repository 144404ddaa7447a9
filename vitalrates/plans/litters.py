"""Litter-level training rows and juvenile-level litter facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.operators.joins import left_join
from vitalrates.operators.rows import order_desc


def litter_training_rows(juvenile: DataFrame, litter: DataFrame) -> DataFrame:
    """(litter_id, grid, part, year, n1_weight, n1_date, litter_size) of litters with a nest date and a weighed pup.

    Litter size counts distinct weighed pups and the year is that of the first nest check; scoring (see
    `litter_facts`) uses the count of all pups and the trial year, as the study defines them. Both tables are
    brought to one row per litter before they meet, so no litter is ever joined row by row.
    """
    weighed = (
        juvenile.filter((F.col("weight") > 0) & F.col("litter_id").isNotNull())
        .groupBy("litter_id")
        .agg(F.avg("weight").alias("n1_weight"), F.countDistinct("squirrel_id").alias("litter_size"))
    )
    dated = (
        litter.filter(F.col("date1").isNotNull() & F.col("id").isNotNull())
        .groupBy(F.col("id").alias("litter_id"), F.year("date1").alias("year"))
        .agg(
            F.min("grid").alias("grid"), F.avg(F.dayofyear("fieldBDate")).alias("part"),
            F.avg(F.dayofyear("date1")).alias("n1_date"),
        )
    )
    return weighed.join(dated, "litter_id").select(
        "litter_id", "grid", "part", "year", "n1_weight", "n1_date", "litter_size"
    )


def litter_facts(
    juvenile: DataFrame, litter: DataFrame, hot_litters: Sequence | None = None, ordered: bool = False
) -> DataFrame:
    """Every juvenile with a litter: its weights, the litter's size, dates and dam; litters may be unknown.

    The size of a litter is counted from its juveniles and joined to the litter first, both one row per litter, so
    the juveniles are shuffled once. `ordered` sorts by litter, descending, for reading.
    """
    sizes = (
        juvenile.filter("litter_id is not null").groupBy("litter_id")
        .agg(F.count("squirrel_id").alias("litter_size"))
    )
    known = litter.select(
        F.col("id").alias("litter_id"), "fieldBDate", F.col("date1").alias("n1_date"),
        F.col("tagDt").alias("n2_date"), F.col("squirrel_id").alias("dam_id"),
    )
    per_litter = sizes.join(known, "litter_id", "left")
    pups = juvenile.select(
        "squirrel_id", "litter_id", F.col("weight").alias("n1_weight"), F.col("tagWT").alias("n2_weight")
    )
    result = left_join(
        pups, per_litter, ["litter_id"], null_safe=False, hot=hot_litters, spread_by=["squirrel_id"], how="inner"
    ).select(
        "squirrel_id", "litter_id", "fieldBDate", "litter_size", "n1_date", "n1_weight", "n2_date", "n2_weight",
        "dam_id",
    )
    return order_desc(result, "litter_id") if ordered else result
