"""Evenly spaced numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spaced(spark: SparkSession, start: float, stop: float, count: int, name: str) -> DataFrame:
    """`count` numbers from `start` to `stop`, both included."""
    step = (stop - start) / (count - 1) if count > 1 else 0.0
    return spark.range(count).select((F.lit(float(start)) + F.col("id") * F.lit(step)).alias(name))


def penalty_grid(count: int = 25, low: float = -10.0, high: float = 0.0) -> list[float]:
    """`count` penalties from 10**low to 10**high, evenly spaced in the exponent."""
    return [10.0 ** (low + i * (high - low) / (count - 1)) for i in range(count)]
