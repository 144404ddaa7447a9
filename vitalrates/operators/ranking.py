"""Exact global ranks, medians and distribution distances without pulling all rows into one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalrates.session import bounded_rows

INF = float("inf")
RANGES = 64
BRACKET_ROWS = 20_000
BINS = 512
#: Cells of [0, 1] in which a distribution distance is searched, and rows of a cell that one task may sort.
CELLS, CELL_ROWS = 65_536, 1_000_000


def _with_range(df: DataFrame, column: str, ranges: int) -> DataFrame:
    """Add `__range`, a consecutive range number along `column`; the cut points are a bounded list of literals."""
    cuts = df.select(F.percentile_approx(
        F.col(column).cast("double"), [i / ranges for i in range(1, ranges)], 1000 * 10
    )).first()[0]
    splits = [-INF, *sorted(set(cuts or [])), INF]
    numbered = df.withColumn("__as_double", F.col(column).cast("double"))
    if len(splits) < 3:
        return numbered.withColumn("__range", F.lit(0)).drop("__as_double")
    return (
        Bucketizer(splits=splits, inputCol="__as_double", outputCol="__range")
        .transform(numbered).withColumn("__range", F.col("__range").cast("int")).drop("__as_double")
    )


def running_total(df: DataFrame, order: str, weight: str, name: str, ranges: int | None = None) -> DataFrame:
    """Add the inclusive running sum of `weight` along the distinct values of `order`.

    Rows are cut into value ranges; each range is summed on its own and shifted by the totals of the ranges before
    it, a table of at most `ranges` rows.
    """
    ranges = ranges or max(RANGES, min(2048, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cut = _with_range(df, order, ranges)
    totals = cut.groupBy("__range").agg(F.sum(weight).alias("__total"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("__range", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(F.broadcast(shifts), "__range")
        .withColumn(name, F.sum(weight).over(inside) + F.col("__shift"))
        .drop("__range", "__shift")
    )


def factor_levels(df: DataFrame, column: str, order: str | None = None, ranges: int | None = None) -> DataFrame:
    """Level table (level, code from 1): first-appearance order along `order`, or ascending when it is None.

    Ascending order needs a numeric column.
    """
    present = df.filter(F.col(column).isNotNull())
    key = F.col(column) if order is None else F.min(order)
    levels = present.groupBy(F.col(column).alias("level")).agg(
        (F.first(column) if order is None else key).alias("__first"), F.lit(1).alias("__one")
    )
    return running_total(levels, "__first", "__one", "code", ranges).select(
        "level", F.col("code").cast("int").alias("code")
    )


@dataclass
class _Bracket:
    """Search state for one middle rank of one column: `inside` rows lie in [lo, hi], `below` rows under it."""

    column: str
    rank: int
    lo: float
    hi: float
    below: int
    inside: int

    def holds(self) -> Column:
        return F.col(self.column).between(self.lo, self.hi)


def exact_medians(df: DataFrame, columns: Sequence[str], bracket_rows: int = BRACKET_ROWS) -> dict[str, float | None]:
    """Exact median (mean of the middle pair) of each column, NULL and NaN skipped.

    One pass counts and guesses a bracket around the middle, one checks it; further passes split the bracket into
    bins until it holds few rows or one value. Driver and tasks hold bins and bracket values only, whatever the
    table size.
    """
    clean = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    first = clean.agg(*[
        F.struct(
            F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"),
            F.percentile_approx(c, [0.499, 0.501], 10_000).alias("guess"),
        ).alias(c)
        for c in columns
    ]).first()
    found: dict[str, list[float]] = {c: [] for c in columns}
    work = [
        _Bracket(c, rank, first[c]["lo"], first[c]["hi"], 0, first[c]["n"])
        for c in columns if first[c]["n"]
        for rank in {(first[c]["n"] + 1) // 2, first[c]["n"] // 2 + 1}
    ]
    if work:
        _try_guess(clean, work, {c: first[c]["guess"] for c in columns})
    while work:
        for b in [b for b in work if b.lo == b.hi]:
            found[b.column].append(b.lo)
        work = [b for b in work if b.lo < b.hi]
        small = [b for b in work if b.inside <= bracket_rows]
        work = [b for b in work if b.inside > bracket_rows]
        if small:
            for b, value in _count_out(clean, small, bracket_rows):
                found[b.column].append(value)
        if work:
            _narrow(clean, work)
    return {c: sum(v) / len(v) if v else None for c, v in found.items()}


def _try_guess(clean: DataFrame, work: list[_Bracket], guesses: dict) -> None:
    """Move to the approximate bracket wherever it really holds the rank."""
    columns = sorted({b.column for b in work})
    counts = clean.agg(*[
        F.struct(
            F.count_if(F.col(c) < guesses[c][0]).alias("below"), F.count_if(F.col(c) <= guesses[c][1]).alias("upto")
        ).alias(c)
        for c in columns
    ]).first()
    for b in work:
        below, upto = counts[b.column]
        if below < b.rank <= upto:
            b.lo, b.hi = guesses[b.column]
            b.below, b.inside = below, upto - below


def _exploded(clean: DataFrame, work: list[_Bracket], fields) -> DataFrame:
    """One row (id, …) per value inside each bracket."""
    return clean.select(F.explode(F.array_compact(F.array(*[
        F.when(b.holds(), F.struct(F.lit(i).alias("id"), *fields(b))) for i, b in enumerate(work)
    ]))).alias("p")).select("p.*")


def _count_out(clean: DataFrame, work: list[_Bracket], bracket_rows: int):
    inside = _exploded(clean, work, lambda b: [F.col(b.column).alias("value")]).groupBy("id", "value").count()
    rows = bounded_rows(inside, bracket_rows * len(work), "median brackets")
    for i, b in enumerate(work):
        seen = b.below
        for value, count in sorted((r["value"], r["count"]) for r in rows if r["id"] == i):
            if seen < b.rank <= seen + count:
                yield b, value
            seen += count


def _narrow(clean: DataFrame, work: list[_Bracket]) -> None:
    """Shrink each bracket to the bin that holds its rank."""

    def fields(b: _Bracket):
        share = (F.col(b.column) - b.lo) / (b.hi - b.lo)
        return [F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin"), F.col(b.column).alias("value")]

    counted = _exploded(clean, work, fields).groupBy("id", "bin").agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    rows = bounded_rows(counted, BINS * len(work), "median bins")
    for i, b in enumerate(work):
        seen = b.below
        for r in sorted((r for r in rows if r["id"] == i), key=lambda r: r["bin"]):
            if seen < b.rank <= seen + r["n"]:
                b.lo, b.hi, b.below, b.inside = r["lo"], r["hi"], seen, r["n"]
                break
            seen += r["n"]


def fill_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL replaced by the exact median of its column."""
    medians = exact_medians(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in columns})


def uniformity_distance(df: DataFrame, column: str, ranges: int | None = None) -> DataFrame:
    """One row (n, ks): the largest gap between the distribution of `column` and the uniform one on [0, 1].

    One pass counts small cells with their ends, which give exact gaps there and bounds between; a second pass ranks only the
    values of cells that may hold a larger gap. Cells too full for a task are ranked along value ranges instead.
    """
    u = F.col("u")
    values = df.select(F.col(column).alias("u")).filter(u.isNotNull())
    cell = F.greatest(F.least(F.floor(u * CELLS), F.lit(CELLS - 1)), F.lit(0))
    cells = values.groupBy(cell.alias("cell")).agg(
        F.count("*").alias("m"), F.min("u").cast("double").alias("lo"), F.max("u").cast("double").alias("hi"))
    found = sorted(bounded_rows(cells, CELLS, "cells"), key=lambda r: r["cell"])
    n, before, ks, at = sum(r["m"] for r in found), 0, None, []
    for r in found:
        upto = before + r["m"]
        gap = max(upto / n - r["hi"], r["lo"] - before / n)
        ks = gap if ks is None else max(ks, gap)
        at.append((r["cell"], before, r["m"], max(upto / n - r["lo"], r["hi"] - before / n)))
        before = upto
    wanted = [(k, b) for k, b, m, most in at if m > 1 and most > ks]
    full = max((m for _, _, m, most in at if most > (ks or 0.0)), default=0) > CELL_ROWS
    if full or any(r["lo"] != r["lo"] or r["hi"] != r["hi"] for r in found):
        return _ranked_distance(df, column, n, ranges)
    if wanted:
        table = F.broadcast(df.sparkSession.createDataFrame(wanted, "cell long, before long"))
        inside = values.withColumn("cell", cell).join(table, "cell").groupBy("cell", "before", "u").agg(F.count("*").alias("c"))
        upto = F.col("before") + F.sum("c").over(Window.partitionBy("cell").orderBy("u"))
        ranked = inside.withColumn("upto", upto)
        most = ranked.agg(F.greatest(F.max(F.col("upto") / n - u), F.max(u - (F.col("upto") - F.col("c")) / n)).cast("double"))
        ks = max(ks, most.first()[0])
    return df.sparkSession.createDataFrame([(n if found else None, ks)], "n long, ks double")


def _ranked_distance(df: DataFrame, column: str, count: int, ranges: int | None) -> DataFrame:
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("u")).agg(F.count("*").alias("c"))
    n = F.lit(count)
    return running_total(values, "u", "c", "upto", ranges).agg(
        F.sum("c").alias("n"),
        F.greatest(
            F.max(F.col("upto") / n - F.col("u")), F.max(F.col("u") - (F.col("upto") - F.col("c")) / n)
        ).alias("ks"),
    )
