"""Tests of quantile residuals: uniformity, dispersion, outliers, and trend along the ranked prediction."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalrates.functions.casting import inverse_logit
from vitalrates.operators.effects import chi_square_tail, normal_tail
from vitalrates.operators.ranking import running_total, uniformity_distance
from vitalrates.session import bounded_rows, cut_lineage

QUARTILES = (0.25, 0.5, 0.75)
BINS = 20
CELLS = 1024
SIMULATIONS = 250  # a residual is an outlier where it lies outside this many draws from the model


def kolmogorov_tail(distance: float, n: int) -> float:
    """Probability of a larger distance between n uniform numbers and their distribution, for large n."""
    x = distance * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    if x < 0.2:
        return 1.0
    total = 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101))
    return min(1.0, max(0.0, total))


def _present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()


def _bin_starts(rows: DataFrame, link: str, bins: int) -> list:
    """(bin, n, start): equal shares of the rows along `link`; equal predictions stay together, so bins may be missing."""
    counted = rows.groupBy(link).agg(F.count("*").alias("c")).persist()
    n = counted.agg(F.sum("c")).first()[0] or 0
    ranked = running_total(counted, link, "c", "upto").withColumn("bin", F.expr(f"(upto - 1) * {bins} div {max(n, 1)}"))
    found = ranked.groupBy("bin").agg(F.sum("c").alias("n"), F.min(link).alias("start"))
    starts = sorted(bounded_rows(found, bins, "bins of the prediction"), key=lambda r: r["bin"])
    counted.unpersist()
    return starts


def _bin_of(link: str, starts: list) -> Column:
    at = reduce(lambda a, b: a + b, [(F.col(link) >= F.lit(r["start"])).cast("int") for r in starts])
    return F.element_at(F.array(*[F.lit(r["bin"]) for r in starts]), at)


def residual_trend(
    df: DataFrame, link: str, residual: str, bins: int = BINS, probabilities: Sequence[float] = QUARTILES
) -> DataFrame:
    """(bin, n, start, probability, quantile, share_below, z): residual quantiles along the ranked prediction.

    Bins hold equal shares of the rows in the order of `link`. Under the model a share `probability` of the residuals
    of each bin lies below `probability`; z is the deviation in standard errors. Quantiles are exact, interpolated
    between neighbouring values. One pass counts small cells of each bin, the other sorts only the cells that hold a
    wanted rank, so no task sees a whole bin. Rows with a missing prediction or residual are left out.
    """
    rows = _present(df, [link, residual])
    starts = _bin_starts(rows, link, bins)
    spark = df.sparkSession
    schema = "bin bigint, n bigint, start double, probability double, quantile double, share_below double, z double"
    if not starts:
        return spark.createDataFrame([], schema)
    cell = F.greatest(F.least(F.floor(F.col(residual) * CELLS), F.lit(CELLS - 1)), F.lit(0))
    placed = rows.select(_bin_of(link, starts).alias("bin"), cell.alias("cell"), F.col(residual).alias("u"))
    below = [F.count_if(F.col("u") < F.lit(float(q))).alias(f"below{i}") for i, q in enumerate(probabilities)]
    cells = cut_lineage(placed.groupBy("bin", "cell").agg(F.count("*").alias("m"), *below))
    upto = F.sum("m").over(Window.partitionBy("bin").orderBy("cell"))
    ranked = cells.withColumn("upto", upto).withColumn("all", F.sum("m").over(Window.partitionBy("bin")))
    # Each quantile lies between two ranks, each with its share of the result.
    targets = ranked.select("bin", "cell", "m", "upto", F.explode(F.flatten(F.array(*[
        F.array(
            F.struct(F.lit(float(q)).alias("probability"), (F.floor(place) + 1).alias("rank"),
                     (1 - (place - F.floor(place))).alias("share")),
            F.struct(F.lit(float(q)).alias("probability"), (F.least(F.floor(place) + 2, F.col("all"))).alias("rank"),
                     (place - F.floor(place)).alias("share")),
        )
        for q in probabilities for place in [(F.col("all") - 1) * F.lit(float(q))]
    ]))).alias("t")).select("bin", "cell", (F.col("upto") - F.col("m")).alias("before"), "upto", "t.*")
    targets = targets.filter("rank > before and rank <= upto").drop("upto")
    wanted = targets.select("bin", "cell", "before").distinct()  # at most two cells per bin and probability
    values = placed.join(F.broadcast(wanted), ["bin", "cell"]).groupBy("bin", "cell", "before", "u").agg(F.count("*").alias("c"))
    order = Window.partitionBy("bin", "cell").orderBy("u")
    values = values.withColumn("last", F.sum("c").over(order) + F.col("before")).drop("before")
    hit = values.join(F.broadcast(targets), ["bin", "cell"]).filter("rank > last - c and rank <= last")
    quantiles = hit.groupBy("bin", "probability").agg(F.sum(F.col("u") * F.col("share")).alias("quantile"))
    q = F.col("probability")
    seen = cells.groupBy("bin").agg(
        F.sum("m").alias("n"), *[F.sum(f"below{i}").alias(f"below{i}") for i in range(len(probabilities))]
    ).select("bin", "n", F.explode(F.array(*[
        F.struct(F.lit(float(p)).alias("probability"), F.col(f"below{i}").alias("below"))
        for i, p in enumerate(probabilities)
    ])).alias("s")).select("bin", "n", "s.*")
    start = F.element_at(F.map_from_arrays(
        F.array(*[F.lit(r["bin"]) for r in starts]), F.array(*[F.lit(r["start"]) for r in starts])), F.col("bin"))
    return seen.join(quantiles, ["bin", "probability"]).select(
        "bin", "n", start.alias("start"), "probability", "quantile", (F.col("below") / F.col("n")).alias("share_below"),
        ((F.col("below") - F.col("n") * q) / F.sqrt(F.col("n") * q * (1 - q))).alias("z"),
    )


def residual_tests(
    df: DataFrame, y: str, link: str, residual: str, bins: int = BINS, probabilities: Sequence[float] = QUARTILES
) -> DataFrame:
    """(test, statistic, expected, p) of the residuals of a 0/1 outcome; an empty table gives no rows.

    `uniformity` is the distance to the uniform distribution; `dispersion` the squared errors over their expectation;
    `outliers` the share of residuals beyond all of 250 draws from the model; `trend_q` the summed squared deviations
    of the shares below q in the bins of the ranked prediction, chi-square distributed with one degree a bin.
    """
    rows = _present(df, [y, link, residual]).persist()  # read by seven passes
    mu, outlier = inverse_logit(F.col(link)), 2 / (SIMULATIONS + 1)
    spread = mu * (1 - mu)
    u = F.col(residual)
    sums = rows.agg(
        F.count("*").alias("n"), F.sum((F.col(y) - mu) ** 2).alias("squares"), F.sum(spread).alias("expected"),
        F.sum(spread * (1 - 2 * mu) ** 2).alias("variance"),
        F.count_if((u < outlier / 2) | (u > 1 - outlier / 2)).alias("outside"),
    ).first()
    out: list[tuple] = []
    n = sums["n"]
    if n:
        distance = uniformity_distance(rows, residual).first()["ks"]
        out.append(("uniformity", float(distance), 0.0, kolmogorov_tail(distance, n)))
        error = math.sqrt(sums["variance"])
        gap = sums["squares"] - sums["expected"]
        ratio = sums["squares"] / sums["expected"] if sums["expected"] else None
        out.append(("dispersion", ratio, 1.0, normal_tail(gap / error) if error else None))
        share = sums["outside"] / n
        out.append(("outliers", share, outlier, normal_tail((share - outlier) / math.sqrt(outlier * (1 - outlier) / n))))
        trend = residual_trend(rows, link, residual, bins, probabilities)
        found = trend.groupBy("probability").agg(F.sum(F.col("z") ** 2).alias("total"), F.count("*").alias("bins"))
        for r in sorted(bounded_rows(found, len(probabilities), "trend"), key=lambda r: r["probability"]):
            out.append((f"trend_{r['probability']:g}", r["total"], float(r["bins"]), chi_square_tail(r["total"], r["bins"])))
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, "test string, statistic double, expected double, p double")
