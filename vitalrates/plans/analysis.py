"""Behaviour scores and the two survival models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.operators import effects
from vitalrates.operators.grouped import standardise, zscore_within
from vitalrates.operators.mixed import MixedFit, fit_mixed_logit
from vitalrates.operators.residuals import quantile_residuals
from vitalrates.operators.rows import complete_cases, require_complete
from vitalrates.operators.scores import add_scores
from vitalrates.rules import ACTIVITY, AGGRESSION
from vitalrates.session import bounded_rows

MAX_GRIDS = 500
GROUPS = ("year", "dam_id", "litter_id")
MODEL_COLUMNS = (
    "survival", "sex", "age_at_trial", "grid_density", "growth_sc", "part_sc", "oft1", "mis1", "grid", *GROUPS,
)
# Fixed value: the year left out of the autumn model.
AUTUMN_EXCLUDED = (2019,)

PRODUCTS = (
    ("part", "density"), ("growth", "density"), ("oft1", "mis1"), ("oft1", "density"), ("mis1", "density"),
    ("oft1", "mis1", "density"),
)


def behaviour_scores(personality: DataFrame) -> DataFrame:
    """Trials with survival as 0/1, growth and birth date relative to grid and year, and two behaviour scores.

    oft1 is the activity score and mis1 the aggression score. All years take part, also those a model drops later.
    """
    numeric = personality.withColumn("survival", F.col("survived_200d").cast("int"))
    relative = zscore_within(numeric, ["grid", "year"], {"growth": "growth_sc", "part": "part_sc"})
    return add_scores(relative, {"oft1": ACTIVITY, "mis1": AGGRESSION})


@dataclass(frozen=True)
class Design:
    """Complete model rows with one DOUBLE column per coefficient, and which columns belong to which term."""

    rows: DataFrame
    outcome: str
    columns: list[str]
    terms: dict[str, list[str]]


def survival_design(
    scored: DataFrame,
    outcome: str,
    exclude_years: Sequence[int] = (),
    order: str = "row_idx",
    scale_before_dropna: bool = False,
    fail_on_missing: bool = False,
) -> Design:
    """Model rows: sex, age, density with relative birth date and growth, both scores with density, and grid.

    Age and density are standardised over the rows that stay, or over all rows with `scale_before_dropna`. The base
    grid is the first to appear along `order`. `fail_on_missing` raises instead of dropping incomplete rows.
    """
    kept = scored.filter(~F.col("year").isin(list(exclude_years)) & F.col("year").isNotNull()) if exclude_years else scored
    needed = [*dict.fromkeys([outcome, *MODEL_COLUMNS])]
    scaled = {"age_at_trial": "age", "grid_density": "density"}
    if scale_before_dropna:
        kept = standardise(kept, scaled)
    rows = require_complete(kept, needed) if fail_on_missing else complete_cases(kept, needed)
    if not scale_before_dropna:
        rows = standardise(rows, scaled)
    first = bounded_rows(rows.groupBy("grid").agg(F.min(order).alias("k")), MAX_GRIDS, "grids")
    grids = [r["grid"] for r in sorted(first, key=lambda r: r["k"])]
    rows = rows.withColumns({
        "constant": F.lit(1.0), "sexM": (F.col("sex") == "M").cast("double"),
        "part_rel": F.col("part_sc"), "growth_rel": F.col("growth_sc"),
        **{f"grid{g}": (F.col("grid") == g).cast("double") for g in grids[1:]},
    })
    source = {"part": "part_rel", "growth": "growth_rel", "density": "density", "oft1": "oft1", "mis1": "mis1"}
    terms: dict[str, list[str]] = {"sex": ["sexM"], "age": ["age"]}
    terms |= {name: [column] for name, column in source.items()}
    terms["grid"] = [f"grid{g}" for g in grids[1:]]
    for parts in PRODUCTS:
        value = F.lit(1.0)
        for part in parts:
            value = value * F.col(source[part])
        name = "_x_".join(parts)
        rows = rows.withColumn(name, value)
        terms[":".join(parts)] = [name]
    terms = {term: columns for term, columns in terms.items() if columns}
    return Design(rows, outcome, ["constant", *[c for cs in terms.values() for c in cs]], terms)


def fit_survival(design: Design, sds: dict[str, float] | None = None, **options) -> MixedFit:
    """Mixed logistic model with year, dam and litter intercepts; without `sds` their deviations are searched for."""
    return fit_mixed_logit(design.rows, design.outcome, design.columns, GROUPS, sds=sds, **options)


def autumn_design(scored: DataFrame, exclude_years: Sequence[int] = AUTUMN_EXCLUDED, **options) -> Design:
    """Survival to the autumn census."""
    return survival_design(scored, "made_it", exclude_years, **options)


def days200_design(scored: DataFrame, **options) -> Design:
    """Survival to 200 days, all years."""
    return survival_design(scored, "survival", **options)


def term_tests(design: Design, fit: MixedFit) -> DataFrame:
    return effects.wald_tests(design.rows.sparkSession, fit, design.terms)


def link_table(design: Design, fit: MixedFit) -> DataFrame:
    """Model rows with the predictor on the link scale, random effects included."""
    return effects.link_predictions(design.rows, fit, {g: g for g in GROUPS})


def residual_table(design: Design, fit: MixedFit, keys: Sequence[str] = ("row_idx",), seed: int = 1) -> DataFrame:
    return quantile_residuals(link_table(design, fit), design.outcome, "link", keys, seed)
