"""The tables behind the plots."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalrates.functions.casting import inverse_logit
from vitalrates.operators.effects import fixed_part
from vitalrates.operators.mixed import MixedFit
from vitalrates.operators.ranking import exact_medians
from vitalrates.operators.sequences import spaced
from vitalrates.plans.analysis import Design


def survival_rates(rows: DataFrame, outcome: str = "made_it", exclude_years: tuple[int, ...] = (2021,)) -> DataFrame:
    """(year, sex, n, survival, survival_rate)."""
    return (
        rows.filter(~F.col("year").isin(list(exclude_years)))
        .groupBy("year", "sex")
        .agg(F.count("*").alias("n"), F.sum(F.col(outcome).cast("bigint")).alias("survival"))
        .withColumn("survival_rate", F.col("survival") / F.col("n"))
    )


@dataclass(frozen=True)
class Ellipse:
    """Centre, covariance and squared radius of a region that holds a share of two scores."""

    x: float
    y: float
    xx: float
    xy: float
    yy: float
    radius2: float

    def axes(self) -> tuple[float, float, float]:
        """Long and short half axis, and the angle of the long one."""
        middle, half = (self.xx + self.yy) / 2, math.hypot((self.xx - self.yy) / 2, self.xy)
        long, short = (math.sqrt(max(v, 0.0) * self.radius2) for v in (middle + half, middle - half))
        return long, short, 0.5 * math.atan2(2 * self.xy, self.xx - self.yy)

    def table(self, spark: SparkSession) -> DataFrame:
        long, short, angle = self.axes()
        return spark.createDataFrame(
            [(self.x, self.y, long, short, angle)],
            "centre_x double, centre_y double, long_axis double, short_axis double, angle double",
        )

    def outline(self, spark: SparkSession, x: str, y: str, segments: int = 51) -> DataFrame:
        """(step, x, y): points around the ellipse."""
        radius = math.sqrt(self.radius2)
        a = math.sqrt(self.xx)
        b = self.xy / a
        c = math.sqrt(max(self.yy - b * b, 0.0))
        turn = F.col("step") * (2 * math.pi / segments)
        return spark.range(segments + 1).select(F.col("id").cast("int").alias("step")).select(
            "step", (F.lit(self.x) + F.cos(turn) * (radius * a)).alias(x),
            (F.lit(self.y) + F.cos(turn) * (radius * b) + F.sin(turn) * (radius * c)).alias(y),
        )


def _radius2(n: int, level: float) -> float:
    m = n - 1
    return m * ((1.0 - level) ** (-2.0 / m) - 1.0)


def normal_ellipse(df: DataFrame, x: str, y: str, level: float = 0.95) -> Ellipse:
    """Ellipse from means and covariances, one pass."""
    r = df.dropna(subset=[x, y]).agg(
        F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"), F.var_samp(x).alias("xx"),
        F.var_samp(y).alias("yy"), F.covar_samp(x, y).alias("xy"),
    ).first()
    return Ellipse(r["x"], r["y"], r["xx"], r["xy"], r["yy"], _radius2(r["n"], level))


def robust_ellipse(
    df: DataFrame, x: str, y: str, level: float = 0.95, freedom: float = 5.0, tolerance: float = 0.01, rounds: int = 25
) -> Ellipse:
    """Ellipse from a multivariate t fit: rows far from the centre count less, one pass per reweighting."""
    rows = df.dropna(subset=[x, y])
    start = rows.agg(
        F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"), F.var_pop(x).alias("xx"),
        F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"),
    ).first()
    n, centre, shape, weight = start["n"], (start["x"], start["y"]), (start["xx"], start["xy"], start["yy"]), F.lit(1.0)
    for _ in range(rounds):
        dx, dy = F.col(x) - centre[0], F.col(y) - centre[1]
        new = _t_weight(dx, dy, shape, freedom)
        r = rows.select(new.alias("w"), F.abs(new - weight).alias("move"), dx.alias("dx"), dy.alias("dy")).agg(
            F.max("move").alias("move"), F.sum("w").alias("w"),
            F.sum(F.col("w") * F.col("dx")).alias("x"), F.sum(F.col("w") * F.col("dy")).alias("y"),
            F.sum(F.col("w") * F.col("dx") * F.col("dx")).alias("xx"),
            F.sum(F.col("w") * F.col("dx") * F.col("dy")).alias("xy"),
            F.sum(F.col("w") * F.col("dy") * F.col("dy")).alias("yy"),
        ).first()
        weight = new
        sx, sy = r["x"] / r["w"], r["y"] / r["w"]
        centre = (centre[0] + sx, centre[1] + sy)
        covariance = tuple(r[k] / n for k in ("xx", "xy", "yy"))
        if r["move"] < tolerance:
            break
        shape = (
            r["xx"] / r["w"] - sx * sx, r["xy"] / r["w"] - sx * sy, r["yy"] / r["w"] - sy * sy,
        )
    else:
        raise RuntimeError(f"the weights still move after {rounds} rounds")
    return Ellipse(*centre, *covariance, _radius2(n, level))


def _t_weight(dx: Column, dy: Column, shape: tuple[float, float, float], freedom: float) -> Column:
    xx, xy, yy = shape
    det = xx * yy - xy * xy
    distance = dx * dx * (yy / det) - dx * dy * (2 * xy / det) + dy * dy * (xx / det)
    return F.lit(freedom + 2.0) / (F.lit(freedom) + distance)


def prediction_grid(rows: DataFrame, score: str = "mis1", points: int = 500) -> DataFrame:
    """Rows to predict on: one score over its range, age and the other score at their mean, base sex and grid.

    The relative birth date and the density are 0, and the relative growth is the median of raw growth, as the study
    draws its curve.
    """
    r = rows.agg(
        F.min(score).alias("low"), F.max(score).alias("high"), F.avg("age_at_trial").alias("age"),
        F.avg("oft1").alias("oft1"),
    ).first()
    growth = exact_medians(rows, ["growth"])["growth"]
    return spaced(rows.sparkSession, r["low"] - 1.0, r["high"], points, score).withColumns({
        "age_at_trial": F.lit(r["age"]), "oft1": F.lit(r["oft1"]), "part_sc": F.lit(0.0), "grid_density": F.lit(0.0),
        "growth_sc": F.lit(growth), "sex": F.lit("F"), "grid": F.lit("KL"),
    })


def design_for(grid: DataFrame, design: Design) -> DataFrame:
    """Design columns of new rows under the scales of the model rows."""
    stats = design.rows.agg(*[
        f(F.col(c).cast("double")).alias(f"{tag}_{c}") for c in ("age_at_trial", "grid_density")
        for tag, f in (("mean", F.avg), ("sd", F.stddev_samp))
    ]).first()
    out = grid.withColumns({
        "constant": F.lit(1.0), "sexM": (F.col("sex") == "M").cast("double"),
        "age": (F.col("age_at_trial") - stats["mean_age_at_trial"]) / stats["sd_age_at_trial"],
        "density": (F.col("grid_density") - stats["mean_grid_density"]) / stats["sd_grid_density"],
        "part_rel": F.col("part_sc"), "growth_rel": F.col("growth_sc"),
        **{c: (F.col("grid") == c.removeprefix("grid")).cast("double") for c in design.terms.get("grid", [])},
    })
    for term, columns in design.terms.items():
        if ":" in term:
            value = F.lit(1.0)
            for part in term.split(":"):
                value = value * F.col(design.terms[part][0])
            out = out.withColumn(columns[0], value)
    return out


def response_curve(design: Design, fit: MixedFit, score: str = "mis1", points: int = 500) -> DataFrame:
    """(score, response, source): fixed-effect survival along one score, with the observed outcomes."""
    grid = design_for(prediction_grid(design.rows, score, points), design)
    curve = grid.select(
        F.col(score), inverse_logit(fixed_part(fit.names, fit.beta)).alias("response"), F.lit("curve").alias("source")
    )
    seen = design.rows.select(
        F.col(score), F.col(design.outcome).cast("double").alias("response"), F.lit("observed").alias("source")
    )
    return curve.unionByName(seen)


def density_links(linked: DataFrame, outcome: str = "made_it") -> DataFrame:
    """(grid_density, mis1, outcome, link) of every model row."""
    return linked.select("grid_density", "mis1", outcome, "link")
