"""Registered queries: each takes (spark, folder of parquet tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalrates.operators.joins import hot_keys
from vitalrates.plans import cones, density, litters, survival, trials
from vitalrates.sources.standins import standin

Query = Callable[[SparkSession, str], DataFrame]

BOXES = density.boxes_after(1996)
REPEAT_YEARS = (1997, 1998)
RECENT = 2001


def shown(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Named columns in comparable types: BIGINT, DOUBLE rounded, dates as text."""
    out = []
    for c in columns or df.columns:
        kind = df.schema[c].dataType.simpleString()
        col = F.col(c)
        if kind in ("int", "smallint", "tinyint"):
            col = col.cast("bigint")
        elif kind.startswith("decimal"):
            col = col.cast("double")
        elif kind in ("double", "float"):
            col = F.round(col.cast("double"), digits)
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            col = col.cast("string")
        out.append(col.alias(c.lower()))
    return df.select(*out)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [standin(spark, sf_dir, n) for n in names]


def study_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.population_density(*tables(spark, sf_dir, "dbamidden", "census"), boxes=BOXES)


def study_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pups, nests = tables(spark, sf_dir, "pup_juvenile", "pup_litter")
    return litters.litter_facts(pups, nests, hot_litters=hot_keys(pups, "litter_id"))


def study_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = standin(spark, sf_dir, "pup_trials")
    return trials.clean_trials(
        raw, study_facts(spark, sf_dir), repeat_years=REPEAT_YEARS, hot_ids=hot_keys(raw, "Sq ID")
    )


def study_survival(spark: SparkSession, sf_dir: str, cleaned: DataFrame | None = None) -> DataFrame:
    last, census, later = tables(spark, sf_dir, "pup_last_seen", "pup_census", "pup_census_next")
    ids = hot_keys(standin(spark, sf_dir, "pup_trials"), "Sq ID")
    return survival.survival_facts(
        study_trials(spark, sf_dir) if cleaned is None else cleaned, last, census, later, RECENT, hot_ids=ids
    )


def study_personality(spark: SparkSession, sf_dir: str, cleaned: DataFrame | None = None) -> DataFrame:
    return survival.attach_density(study_survival(spark, sf_dir, cleaned), study_density(spark, sf_dir))


def q1(spark, sf_dir):
    return shown(study_density(spark, sf_dir))


def q2(spark, sf_dir):
    out = cones.cone_counts(
        standin(spark, sf_dir, "cones"), mast_years=(1998, 2000), feeding=(("AG", 1996, 1999),)
    )
    return shown(out).withColumns({c: F.col(c).cast("int") for c in ("mast", "exp_label")})


def q3(spark, sf_dir):
    return shown(litters.litter_training_rows(*tables(spark, sf_dir, "juvenile", "litter")))


def q4(spark, sf_dir):
    pups, nests = tables(spark, sf_dir, "juvenile", "litter")
    return shown(litters.litter_facts(pups, nests, hot_litters=hot_keys(pups, "litter_id"), ordered=True))


def q5(spark, sf_dir):
    return shown(study_trials(spark, sf_dir))


SURVIVAL_COLUMNS = (
    "squirrel_id", "litter_id", "dam_id", "row_idx", "byear", "made_it", "age_at_trial", "longevity",
    "survived_200d", "nest_days", "growth", "dates", "f1", "datee", "f2",
)


def q7(spark, sf_dir):
    return shown(study_survival(spark, sf_dir), *SURVIVAL_COLUMNS)


def q8(spark, sf_dir):
    return shown(
        study_personality(spark, sf_dir), "row_idx", "squirrel_id", "grid", "year", "made_it", "survived_200d",
        "grid_density",
    )


QUERIES: dict[str, Query] = {
    "Q1_population_density": q1,
    "Q2_cone_counts": q2,
    "Q3_litter_training_rows": q3,
    "Q4_litter_facts": q4,
    "Q5_clean_trials": q5,
    "Q7_survival_facts": q7,
    "Q8_density_on_trials": q8,
}
