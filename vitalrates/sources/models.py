"""Storing and loading fitted models."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from vitalrates.operators.mixed import MixedFit
from vitalrates.session import bounded_rows

TERMS = "position int, term string, estimate double, covariance array<double>"
DEVIATIONS = "position int, grouping string, sd double, levels bigint"
SUMMARY = "minus_two_loglik double, rows bigint, passes int, deviance_error double"
COMMITS = "number bigint, version string"
MAX_TERMS = 10_000


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_mixed_fit(spark: SparkSession, fit: MixedFit, path: str) -> str:
    """Store a mixed fit as Parquet tables under `path` and return the name of its version.

    Every save writes a folder of its own and then one row into the table of commits, so a reader sees the last whole
    version while a new one is written, and never one that was broken off. Level tables stay DataFrames throughout.
    """
    version = uuid.uuid4().hex
    folder = f"{path}/{version}"
    terms = [(i, name, float(fit.beta[i]), [float(v) for v in fit.covariance[i]]) for i, name in enumerate(fit.names)]
    deviations = [(i, g, float(sd), int(fit.level_counts[g])) for i, (g, sd) in enumerate(fit.sds.items())]
    summary = [(float(fit.minus_two_loglik), int(fit.rows), int(fit.passes), float(fit.deviance_error))]
    spark.createDataFrame(terms, TERMS).coalesce(1).write.parquet(f"{folder}/terms")
    spark.createDataFrame(deviations, DEVIATIONS).coalesce(1).write.parquet(f"{folder}/deviations")
    spark.createDataFrame(summary, SUMMARY).coalesce(1).write.parquet(f"{folder}/summary")
    for position, (grouping, table) in enumerate(fit.effects.items()):
        table.selectExpr("cast(level as string) level", "cast(effect as double) effect").write.parquet(
            f"{folder}/effects/{position}")
    names = [(i, g) for i, g in enumerate(fit.effects)]
    spark.createDataFrame(names, "position int, grouping string").coalesce(1).write.parquet(f"{folder}/groupings")
    number = max([r["number"] for r in _commits(spark, path)], default=0) + 1
    spark.createDataFrame([(number, version)], COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return version


def load_mixed_fit(spark: SparkSession, path: str, version: str | None = None) -> MixedFit:
    """The last stored fit under `path`, or the given version; two saves that ended together are told apart by name."""
    commits = sorted((r["number"], r["version"]) for r in _commits(spark, path))
    known = [v for _, v in commits]
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no stored fit {version or ''} under {path}")
    folder = f"{path}/{version or known[-1]}"

    def rows(name: str, schema: str, key: Callable = lambda r: r["position"]) -> list:
        return sorted(bounded_rows(spark.read.schema(schema).parquet(f"{folder}/{name}"), MAX_TERMS, name), key=key)

    terms, deviations = rows("terms", TERMS), rows("deviations", DEVIATIONS)
    summary = rows("summary", SUMMARY, key=lambda r: r["rows"])[0]
    effects: dict[str, DataFrame] = {
        r["grouping"]: spark.read.schema("level string, effect double").parquet(f"{folder}/effects/{r['position']}")
        for r in rows("groupings", "position int, grouping string")
    }
    return MixedFit(
        [r["term"] for r in terms], np.array([r["estimate"] for r in terms]),
        np.array([r["covariance"] for r in terms]).reshape(len(terms), len(terms)),
        {r["grouping"]: r["sd"] for r in deviations}, effects, summary["minus_two_loglik"], summary["rows"],
        {r["grouping"]: r["levels"] for r in deviations}, summary["passes"], summary["deviance_error"],
    )


def _commits(spark: SparkSession, path: str) -> list:
    try:
        return spark.read.schema(COMMITS).parquet(f"{path}/commits").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
