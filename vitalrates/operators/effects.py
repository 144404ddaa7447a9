"""Tables read from a fitted survival model."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalrates.operators.joins import attach_small
from vitalrates.operators.mixed import MixedFit

#: Bound of a table of effects that is sent to the tasks instead of shuffling the rows by their level.
EFFECT_BYTES = 64 << 20


def normal_tail(z: float) -> float:
    """Two-sided tail probability of the standard normal distribution."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi_square_tail(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution with whole degrees of freedom."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    term = math.exp(-half) if df % 2 == 0 else 2.0 * math.sqrt(half / math.pi) * math.exp(-half)
    total = 0.0 if df % 2 == 0 else math.erfc(math.sqrt(half))
    start = 0.0 if df % 2 == 0 else 0.5
    for k in range(df // 2):
        total += term
        term *= half / (start + k + 1)
    return total


def fixed_effects(spark: SparkSession, fit: MixedFit) -> DataFrame:
    """(term, estimate, std_error, z, p)."""
    rows = []
    for i, name in enumerate(fit.names):
        error = math.sqrt(fit.covariance[i, i])
        z = float(fit.beta[i]) / error
        rows.append((name, float(fit.beta[i]), error, z, normal_tail(z)))
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, z double, p double")


def random_effects(spark: SparkSession, fit: MixedFit) -> DataFrame:
    """(grouping, sd, levels)."""
    rows = [(g, sd, int(fit.level_counts[g])) for g, sd in fit.sds.items()]
    return spark.createDataFrame(rows, "grouping string, sd double, levels bigint")


def model_summary(spark: SparkSession, fit: MixedFit) -> DataFrame:
    """One row (n, parameters, log_likelihood, deviance, aic)."""
    count = len(fit.beta) + len(fit.sds)
    row = (fit.rows, count, -fit.minus_two_loglik / 2, fit.minus_two_loglik, fit.aic)
    return spark.createDataFrame(
        [row], "n bigint, parameters int, log_likelihood double, deviance double, aic double"
    )


def wald_tests(spark: SparkSession, fit: MixedFit, terms: dict[str, Sequence[str]]) -> DataFrame:
    """(term, chi_square, df, p): each term tested after all terms that do not contain it.

    `terms` maps a term such as `a:b` to its columns. A term is contained in those that have all its factors, and its
    statistic is what it adds to the joint Wald statistic of the terms containing it.
    """
    at = {name: i for i, name in enumerate(fit.names)}

    def joint(columns: Sequence[str]) -> float:
        index = [at[c] for c in columns]
        if not index:
            return 0.0
        return float(fit.beta[index] @ np.linalg.solve(fit.covariance[np.ix_(index, index)], fit.beta[index]))

    rows = []
    for term, columns in terms.items():
        parts = set(term.split(":"))
        above = [c for other, cs in terms.items() if other != term and parts < set(other.split(":")) for c in cs]
        value = joint([*above, *columns]) - joint(above)
        rows.append((term, value, len(columns), chi_square_tail(value, len(columns))))
    return spark.createDataFrame(rows, "term string, chi_square double, df int, p double")


def fixed_part(fit_names: Sequence[str], beta: Sequence[float]) -> Column:
    """Linear predictor of the fixed effects from design columns of the same names."""
    terms = [F.col(f"`{n}`") * F.lit(float(b)) for n, b in zip(fit_names, beta)]
    return sum(terms[1:], terms[0])


def link_predictions(rows: DataFrame, fit: MixedFit, groups: dict[str, str], name: str = "link") -> DataFrame:
    """`rows` with the predictor on the link scale; `groups` maps a factor to its column; unseen levels count 0."""
    out = rows.withColumn(name, fixed_part(fit.names, fit.beta))
    for factor, column in groups.items():
        effects = fit.effects[factor].select(F.col("level").alias("__level"), F.col("effect").alias("__effect"))
        keyed = out.withColumn("__key", F.col(column).cast("string"))
        joined = attach_small(keyed, effects, [("__key", "__level")], null_safe=False, max_bytes=EFFECT_BYTES)
        out = joined.withColumn(name, F.col(name) + F.coalesce("__effect", F.lit(0.0))).drop("__key", "__effect")
    return out


def fit_plain_logit(df: DataFrame, y: str, x: Sequence[str]) -> DataFrame:
    """(term, estimate, std_error, z, p) of a logistic regression without random effects; the constant is added."""
    data = VectorAssembler(inputCols=list(x), outputCol="__features").transform(df.withColumn(y, F.col(y).cast("double")))
    model = GeneralizedLinearRegression(
        family="binomial", link="logit", labelCol=y, featuresCol="__features", tol=1e-10, maxIter=50
    ).fit(data)
    summary = model.summary
    estimates = [*map(float, model.coefficients), float(model.intercept)]
    rows = [
        (name, b, float(se), b / float(se), normal_tail(b / float(se)))
        for name, b, se in zip([*x, "constant"], estimates, summary.coefficientStandardErrors)
    ]
    return df.sparkSession.createDataFrame(
        rows, "term string, estimate double, std_error double, z double, p double"
    )
