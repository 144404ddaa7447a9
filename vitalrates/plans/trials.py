"""Cleaning of behaviour trials and their litter facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.functions.dates import day_of_year, parse_short_date
from vitalrates.operators.grouped import keep_first_trials
from vitalrates.operators.joins import left_join
from vitalrates.operators.rows import clean_names, select_renamed
from vitalrates.rules import TRIAL_COLUMNS

# Years and observer of the repeated trials, and the observer of the excluded experiment.
REPEAT_YEARS, REPEAT_OBSERVER, EXCLUDED_OBSERVER = (2017, 2018), "ARM", "SWK"


def usable_trials(
    raw: DataFrame,
    order: str = "row_idx",
    repeat_years: Sequence[int] = REPEAT_YEARS,
    hot_ids: Sequence | None = None,
) -> DataFrame:
    """Trials of juveniles that need no caution, without the repeats, under tidy names.

    `order` names the column that fixes the input order of the rows; it is kept. A missing flag drops the row.
    """
    tidy = clean_names(raw)
    kept = tidy.filter(
        (F.col("ageclass") == "J")
        & (F.col("exclude_unless_video_reanalyzed") == "N")
        & (F.col("proceed_with_caution") == "N")
        & (F.col("observer") != EXCLUDED_OBSERVER)
    )
    first = keep_first_trials(kept, ["sq_id", "year"], repeat_years, REPEAT_OBSERVER, order, hot_ids)
    return select_renamed(first, [("squirrel_id", "sq_id"), *TRIAL_COLUMNS, order])


def clean_trials(
    raw: DataFrame,
    facts: DataFrame,
    order: str = "row_idx",
    repeat_years: Sequence[int] = REPEAT_YEARS,
    hot_ids: Sequence | None = None,
) -> DataFrame:
    """Usable trials with litter facts (missing ids meet missing ids) and day-of-year columns."""
    trials = usable_trials(raw, order, repeat_years, hot_ids)
    joined = left_join(trials, facts, ["squirrel_id"], hot=hot_ids, spread_by=[order])
    return joined.withColumns({
        "part": day_of_year(F.col("fieldBDate")),
        "n1_date": day_of_year(F.col("n1_date")),
        "trialdate": parse_short_date(F.col("trialdate")),
    }).withColumn("julian_trialdate", day_of_year(F.col("trialdate")))


def missing_birth_dates(trials: DataFrame) -> DataFrame:
    """Trials whose birth date is still missing, with the columns that explain why."""
    return trials.filter(F.col("part").isNull()).select("squirrel_id", "year", "litter_id", "dam_id", "n1_date")
