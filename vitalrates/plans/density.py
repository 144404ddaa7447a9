"""Animals per hectare by grid and year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalrates.functions.casting import to_tenths
from vitalrates.functions.coordinates import database_tenths, grid_coordinate
from vitalrates.operators.rows import in_boxes
from vitalrates.rules import GRID_AREA, GRID_BOXES, OTHER_AREA, GridBox

LOCATED = ("reflo", "squirrel_id", "locx", "locy", "grid", "date", "sex")


def boxes_after(year: int, grid: str = "LL", boxes: Sequence[GridBox] = GRID_BOXES) -> tuple[GridBox, ...]:
    """The counted regions with another last uncounted year for one grid."""
    return tuple(b._replace(after_year=year) if b.grid == grid else b for b in boxes)


def grid_area(grid: Column) -> Column:
    """Hectares of a grid; every grid not listed has the common area."""
    chain = None
    for name, area in GRID_AREA.items():
        chain = F.when(grid == name, F.lit(area)) if chain is None else chain.when(grid == name, F.lit(area))
    return chain.otherwise(F.lit(OTHER_AREA))


def located_records(midden: DataFrame, census: DataFrame, distinct: bool = False) -> DataFrame:
    """Midden and census records under common names, without records of unknown animals.

    `distinct` removes equal records, which costs a shuffle and which no distinct count needs.
    """
    first = midden.filter("squirrel_id is not null").select(
        *[F.col(c).alias(c) for c in ("reflo", "squirrel_id", "locx", "locy", "grid")],
        F.col("date").cast("date").alias("date"), F.col("sex").alias("sex"),
    )
    second = census.filter("squirrel_id is not null").select(
        "reflo", "squirrel_id", F.col("locx").alias("locx"), F.col("locy").alias("locy"),
        F.col("gr").alias("grid"), F.col("census_date").cast("date").alias("date"), F.col("sex").alias("sex"),
    )
    both = first.union(second)
    return both.distinct() if distinct else both


def placed_records(records: DataFrame, strict_compat: bool = False) -> DataFrame:
    """Records with numeric coordinates and the calendar year; grid names compare without case."""
    return records.withColumns({
        "grid": F.upper("grid"),
        "year": F.year("date"),
        "locx": grid_coordinate(F.col("locx"), strict_compat),
        "locy": database_tenths(F.col("locy")) if strict_compat else to_tenths(F.col("locy")),
    })


def counted_by_rule(records: DataFrame, boxes: Sequence[GridBox] = GRID_BOXES) -> DataFrame:
    """The records inside a counted region, by joining the fixed rule table instead of one long condition."""
    spark = records.sparkSession
    rules = spark.createDataFrame(
        [tuple(b) for b in boxes],
        "r_grid string, r_month int, r_after int, x_lo decimal(4,1), x_hi decimal(4,1), "
        "y_lo decimal(4,1), y_hi decimal(4,1)",
    )
    inside = (
        (F.col("grid") == F.col("r_grid")) & (F.month("date") == F.col("r_month"))
        & (F.col("r_after").isNull() | (F.col("year") > F.col("r_after")))
        & F.col("locx").between(F.col("x_lo"), F.col("x_hi")) & F.col("locy").between(F.col("y_lo"), F.col("y_hi"))
    )
    return records.join(F.broadcast(rules), inside, "left_semi")


def population_density(
    midden: DataFrame,
    census: DataFrame,
    boxes: Sequence[GridBox] = GRID_BOXES,
    strict_compat: bool = False,
) -> DataFrame:
    """(grid, year, spr_number, area, spr_density): distinct animals in the counted region and animals per hectare."""
    records = placed_records(located_records(midden, census), strict_compat)
    inside = records.filter(
        in_boxes(F.month("date"), F.col("year"), F.col("grid"), F.col("locx"), F.col("locy"), boxes)
    )
    counts = inside.groupBy("grid", "year").agg(F.countDistinct("squirrel_id").alias("spr_number"))
    area = grid_area(F.col("grid"))
    return counts.withColumn("area", area).withColumn(
        "spr_density", F.round(F.col("spr_number") / F.col("area"), 4)
    )
