"""Survival flags, ages, growth and density per trial."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.functions.casting import divide, fill_missing
from vitalrates.functions.dates import before_year, days_between, in_year
from vitalrates.operators.joins import attach_small, left_join
from vitalrates.operators.rows import bind_rows

# The cohort judged by the next census instead of its last sighting, the autumn month, the span in days.
RECENT_COHORT, AUTUMN_MONTH, SURVIVAL_DAYS = 2021, 8, 200


def autumn_census(
    census: DataFrame, next_census: DataFrame, recent: int = RECENT_COHORT, dedupe: bool = False
) -> DataFrame:
    """(squirrel_id, census_year, made_it = 1): seen in an August census, or for the recent cohort in the next year.

    An animal recorded twice in a census appears twice unless `dedupe` is set.
    """
    seen = census.filter((F.month("census_date") == AUTUMN_MONTH) & before_year(F.col("census_date"), recent)).select(
        "squirrel_id", F.year("census_date").alias("census_year"), F.lit(1).alias("made_it")
    )
    later = next_census.filter(in_year(F.col("census_date"), recent + 1)).select(
        "squirrel_id", F.lit(recent).alias("census_year"), F.lit(1).alias("made_it")
    )
    both = bind_rows(seen, later)
    return both.distinct() if dedupe else both


def survival_facts(
    trials: DataFrame,
    last_seen: DataFrame,
    census: DataFrame,
    next_census: DataFrame,
    recent: int = RECENT_COHORT,
    dedupe: bool = False,
    hot_ids: Sequence | None = None,
    order: str = "row_idx",
) -> DataFrame:
    """Trials with made_it, age_at_trial, longevity, survived_200d, nest_days and growth.

    The census is joined to the last sightings first: a trial without a sighting has no birth year and so cannot be
    in the census, which makes the order of the two joins free and lets the trials be shuffled once. `order` tells
    the trials of one animal apart; hot ids are spread by it.
    An unknown birth year or longevity, and cohorts after the recent one, give survived_200d = FALSE.
    """
    seen = last_seen.select("squirrel_id", "dates", "f1", "byear", "litter_id", "dam_id", "datee", "f2")
    records = autumn_census(census, next_census, recent, dedupe)
    known = left_join(seen, records, ["squirrel_id", ("byear", "census_year")])
    joined = left_join(
        trials, known, ["squirrel_id", "litter_id", "dam_id"], suffixes=("_per", "_fla"), hot=hot_ids, spread_by=[order]
    )
    longevity = days_between(F.col("datee"), F.col("fieldBDate"))
    nest_days = days_between(F.col("n2_date"), F.col("fieldBDate")).cast("double")
    return fill_missing(joined, {"made_it": 0}).withColumns({
        "age_at_trial": F.col("julian_trialdate") - F.col("part"),
        "longevity": longevity,
        "nest_days": nest_days,
    }).withColumns({
        "survived_200d": F.when((F.col("byear") == recent) & (F.col("made_it") == 1), True)
        .when((F.col("byear") < recent) & (F.col("longevity") >= SURVIVAL_DAYS), True)
        .otherwise(False),
        "growth": divide(F.col("n2_weight") - F.col("n1_weight"), F.col("nest_days")),
    })


def attach_density(trials: DataFrame, density: DataFrame, hot: Sequence | None = None) -> DataFrame:
    """Trials with the density of their grid and year."""
    table = density.select("grid", "year", F.col("spr_density").alias("grid_density"))
    return attach_small(trials, table, ["grid", "year"], hot=hot)
