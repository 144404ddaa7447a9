"""Casts, missing values and arithmetic with missing-value rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_unsigned(c: Column) -> Column:
    """Unsigned 64-bit whole number as the database casts to it.

    Text gives its leading whole number, so a fraction is dropped and text without one is 0; numbers are rounded.
    Values are held inside the range of 64 bits, and negative ones count back from 2^64. NULL stays NULL.
    """
    wide = "decimal(38,0)"
    lead = F.regexp_extract(c.cast("string"), r"^\s*([+-]?[0-9]{1,30})", 1)
    text = F.when(lead == "", F.lit(0)).otherwise(lead.try_cast(wide))
    whole = F.when(F.typeof(c) == "string", text).otherwise(c.try_cast(wide))
    # Whole numbers beyond a signed 64-bit value reach the JVM as text.
    most, modulus = (F.lit(str(v)).cast(wide) for v in (2**64 - 1, 2**64))
    held = F.greatest(F.least(whole, most), F.lit(str(-(2**63))).cast(wide))
    return F.when(c.isNotNull(), F.when(held < 0, held + modulus).otherwise(held)).cast("decimal(20,0)")


def to_tenths(c: Column) -> Column:
    """DECIMAL(4,1); text that is no number, or is out of range, becomes NULL."""
    return c.try_cast("decimal(4,1)")


def truncate_to_int(c: Column) -> Column:
    """Integer by dropping the fraction; NaN and out-of-range values become NULL."""
    return finite(c).try_cast("int")


def finite(c: Column) -> Column:
    """NaN and infinities as NULL, so that comparisons stay three-valued."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def divide(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL for a zero divisor."""
    return F.try_divide(numerator, denominator)


def fill_missing(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """NULL replaced by a constant, column by column."""
    return df.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in values.items()})


def logit(p: Column) -> Column:
    return F.log(divide(p, F.lit(1.0) - p))


def inverse_logit(eta: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
