"""Calendar expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_short_date(c: Column) -> Column:
    """`m/d/yy` text to DATE; years 69–99 belong to the 1900s, 00–68 to the 2000s; bad text is NULL."""
    parsed = F.try_to_date(c, "M/d/yy")
    return F.when(F.year(parsed) >= 2069, F.add_months(parsed, -1200)).otherwise(parsed)


def day_of_year(c: Column) -> Column:
    return F.dayofyear(c)


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def before_year(c: Column, year: int) -> Column:
    """YEAR(c) < year as a range test, which file and JDBC sources can push down."""
    return c < F.lit(date(year, 1, 1))


def in_year(c: Column, year: int) -> Column:
    """YEAR(c) = year as a range test."""
    return (c >= F.lit(date(year, 1, 1))) & (c < F.lit(date(year + 1, 1, 1)))
