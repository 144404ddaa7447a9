"""Birth dates estimated from first-nest weights by a bootstrap-tuned lasso, and their use for missing dates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Interaction, OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalrates.functions.casting import finite, truncate_to_int
from vitalrates.operators.cell_lasso import cell_products, cell_tuning_table
from vitalrates.operators.lasso import penalty_scores
from vitalrates.operators.resample import bootstrap_weights, exact_bootstrap, train_test_split
from vitalrates.operators.rows import best_row
from vitalrates.operators.sequences import penalty_grid
from vitalrates.session import bounded_rows

MAX_LEVELS = 200


@dataclass(frozen=True)
class Roles:
    """What each column of the training table is for."""

    outcome: str = "part"
    identifier: str = "litter_id"
    numbers: tuple[str, ...] = ("n1_weight", "n1_date", "litter_size")
    factors: tuple[str, str] = ("grid", "year")


@dataclass(frozen=True)
class BirthDateFit:
    """A fitted birth-date model with how it was chosen and how it did on the held-out rows."""

    model: PipelineModel
    penalty: float
    scores: DataFrame
    metrics: dict[str, float]


def level_lists(df: DataFrame, roles: Roles, order: str | None = None) -> dict[str, list[str]]:
    """Levels of each factor as text, by first appearance along `order`; numeric factors ascend."""
    result = {}
    for f in roles.factors:
        numeric = df.schema[f].dataType.simpleString() != "string"
        key = F.col(f).cast("double") if numeric else F.min(order or roles.identifier)
        levels = df.filter(F.col(f).isNotNull()).groupBy(f).agg(
            (F.first(F.col(f).cast("double")) if numeric else key).alias("k")
        )
        rows = bounded_rows(levels, MAX_LEVELS, f"levels of {f}")
        result[f] = [str(r[f]) for r in sorted(rows, key=lambda r: r["k"])]
    return result


def design_columns(df: DataFrame, roles: Roles, levels: dict[str, list[str]]) -> tuple[DataFrame, list[str]]:
    """Numbers, treatment dummies (first level left out) and grid-by-year products as DOUBLE columns x0, x1, …"""
    first, second = roles.factors
    dummies = {
        f: [(F.col(f).cast("string") == level).cast("double") for level in levels[f][1:]] for f in roles.factors
    }
    terms = [F.col(c).cast("double") for c in roles.numbers] + dummies[first] + dummies[second]
    terms += [a * b for a in dummies[first] for b in dummies[second]]
    names = [f"x{i}" for i in range(len(terms))]
    return df.withColumns(dict(zip(names, terms))), names


def level_numbers(df: DataFrame, roles: Roles, levels: dict[str, list[str]], names: tuple[str, str]) -> DataFrame:
    """Add the place of each factor's level in its list, from 0; a level that is not listed counts as the first."""
    places = [
        F.greatest(F.array_position(F.lit(levels[f]), F.col(f).cast("string")) - 1, F.lit(0)) for f in roles.factors
    ]
    return df.withColumns(dict(zip(names, places)))


def tune(
    training: DataFrame, roles: Roles, levels: dict[str, list[str]], times: int = 25,
    penalties: Sequence[float] | None = None, seed: int = 1, exact_draws: bool = False,
) -> DataFrame:
    """(penalty, rmse) over bootstrap replicates: all fits come from one scan of the training rows into sums by cell.

    With `exact_draws` each replicate draws exactly as many rows as there are; the identifier must be unique then.
    """
    penalties = list(penalties or penalty_grid())
    needed = [*roles.numbers, *roles.factors, roles.outcome]
    rows = training.dropna(subset=needed)
    center = rows.agg(*[F.avg(F.col(c).cast("double")) for c in [*roles.numbers, roles.outcome]]).first()
    weigh = exact_bootstrap if exact_draws else bootstrap_weights
    cell = ("__first", "__second")
    weighted = level_numbers(weigh(rows, [roles.identifier], times, seed), roles, levels, cell)
    products = cell_products(weighted, roles.numbers, roles.outcome, cell, "weights", [m or 0.0 for m in center])
    return penalty_scores(cell_tuning_table(products, penalties, len(roles.numbers)))


def final_model(training: DataFrame, roles: Roles, levels: dict[str, list[str]], penalty: float) -> PipelineModel:
    """Lasso at one penalty as a Spark ML pipeline of encoders, products and regression."""
    stages = []
    data = training.dropna(subset=[*roles.numbers, *roles.factors, roles.outcome]).withColumns(
        {f: F.col(f).cast("string") for f in roles.factors}
    )
    for f in roles.factors:
        # The encoder leaves out its last category, so the base level goes last.
        labels = [*levels[f][1:], levels[f][0]]
        indexer = StringIndexerModel.from_labels(labels, inputCol=f, outputCol=f"{f}_index", handleInvalid="error")
        data = indexer.transform(data)
        encoder = OneHotEncoder(inputCol=f"{f}_index", outputCol=f"{f}_dummies", dropLast=True).fit(data)
        data = encoder.transform(data)
        stages += [indexer, encoder]
    parts = [*roles.numbers, *[f"{f}_dummies" for f in roles.factors]]
    if all(len(levels[f]) > 1 for f in roles.factors):
        products = Interaction(inputCols=[f"{f}_dummies" for f in roles.factors], outputCol="products")
        data = products.transform(data)
        stages.append(products)
        parts.append("products")
    assembler = VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="error")
    data = assembler.transform(data)
    regression = LinearRegression(
        labelCol=roles.outcome, featuresCol="features", predictionCol="pred", elasticNetParam=1.0, regParam=penalty,
        standardization=True, maxIter=500, tol=1e-9,
    )
    stages += [assembler, regression.fit(data)]
    return PipelineModel(stages=stages)


def known_labels(model: PipelineModel) -> dict[str, list[str]]:
    return {s.getInputCol(): list(s.labels) for s in model.stages if isinstance(s, StringIndexerModel)}


def predict(model: PipelineModel, df: DataFrame, roles: Roles = Roles(), name: str = "pred") -> DataFrame:
    """`df` with the prediction in `name`; a missing number or a level unseen in training gives NULL."""
    labels = known_labels(model)
    usable: Column = F.lit(True)
    for c in roles.numbers:
        usable = usable & finite(F.col(c)).isNotNull()
    for f in roles.factors:
        usable = usable & F.col(f).isNotNull() & F.col(f).cast("string").isin(labels[f])
    safe = df.withColumn("__usable", usable).withColumns({
        **{f"__{c}": F.col(c) for c in (*roles.numbers, *roles.factors)},
        **{c: F.when(F.col("__usable"), F.col(c).cast("double")).otherwise(F.lit(0.0)) for c in roles.numbers},
        **{f: F.when(F.col("__usable"), F.col(f).cast("string")).otherwise(F.lit(labels[f][0])) for f in roles.factors},
    })
    scored = model.transform(safe).withColumn(name, F.when(F.col("__usable"), F.col("pred")))
    restored = scored.withColumns({c: F.col(f"__{c}") for c in (*roles.numbers, *roles.factors)})
    return restored.select(*df.columns, name)


def holdout_metrics(model: PipelineModel, testing: DataFrame, roles: Roles) -> dict[str, float]:
    scored = predict(model, testing, roles).dropna(subset=["pred", roles.outcome])
    evaluator = RegressionEvaluator(labelCol=roles.outcome, predictionCol="pred")
    return {m: evaluator.evaluate(scored, {evaluator.metricName: m}) for m in ("rmse", "r2")}


def fit_birth_date_model(
    training_rows: DataFrame, roles: Roles = Roles(), times: int = 25, penalties: Sequence[float] | None = None,
    share: float = 0.8, seed: int = 1, order: str | None = None,
) -> BirthDateFit:
    """Split, tune over bootstrap replicates, refit on the training share, and score the held-out share."""
    columns = list(dict.fromkeys([roles.identifier, *roles.numbers, *roles.factors, roles.outcome]))
    columns += [order] if order and order not in columns else []
    # Tuning and fitting read the litter-level rows several times; the joins behind them run once.
    dated = training_rows.filter(F.col(roles.outcome).isNotNull()).select(*columns).persist()
    try:
        levels = level_lists(dated, roles, order)
        training, testing = train_test_split(dated, [roles.identifier], share, seed)
        scores = tune(training, roles, levels, times, penalties, seed)
        kept = scores.sparkSession.createDataFrame(bounded_rows(scores, 10_000, "penalties"), scores.schema)
        penalty = best_row(kept, "rmse", "penalty").first()["penalty"]
        model = final_model(training, roles, levels, penalty)
        return BirthDateFit(model, penalty, kept, holdout_metrics(model, testing, roles))
    finally:
        dated.unpersist()


def impute_birth_dates(trials: DataFrame, model: PipelineModel, roles: Roles = Roles()) -> DataFrame:
    """Trials with a missing day of birth filled by the truncated prediction, in one pass."""
    scored = predict(model, trials, roles, "__pred")
    return scored.withColumn(
        roles.outcome, F.coalesce(F.col(roles.outcome).cast("int"), truncate_to_int(F.col("__pred")))
    ).drop("__pred")
