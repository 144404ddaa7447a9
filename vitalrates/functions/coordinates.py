"""Alphanumeric grid lines as numbers."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalrates.functions.casting import to_tenths

NUMBER_PREFIX = r"^\s*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+))"


def grid_coordinate(c: Column, strict_compat: bool = False) -> Column:
    """DECIMAL(4,1) position of a grid line such as `K.5` (11.5): letters count A=1 … Z=26.

    By default case is ignored and text with two different letters is NULL. `strict_compat` gives the values the
    original database query gives: lines with a digit 1 and no letter A–H are taken for line I, only capitals are
    replaced, whatever does not start with a number is 0.0, and values beyond ±999.9 are clamped.
    """
    if strict_compat:
        return _database_decimal(_database_letters(c))
    text = F.upper(c)
    letter = F.regexp_extract(text, "[A-Z]", 0)
    number = (F.ascii(letter) - F.lit(64)).cast("string")
    return to_tenths(F.when(letter == "", text).otherwise(F.replace(text, letter, number)))


def _database_letters(c: Column) -> Column:
    upper = F.upper(c)
    chain = None
    for number, letter in enumerate(string.ascii_uppercase, start=1):
        probe = upper.contains("1" if letter == "I" else letter)
        value = F.replace(c, F.lit(letter), F.lit(str(number)))
        chain = F.when(probe, value) if chain is None else chain.when(probe, value)
    return chain.otherwise(c)


def database_tenths(c: Column) -> Column:
    """Text to DECIMAL(4,1) as a permissive database reads it: leading number or 0.0, clamped."""
    return _database_decimal(c)


def _database_decimal(text: Column) -> Column:
    number = F.regexp_extract(text, NUMBER_PREFIX, 1).try_cast("double")
    clamped = F.greatest(F.least(F.coalesce(number, F.lit(0.0)), F.lit(999.9)), F.lit(-999.9))
    return F.when(text.isNotNull(), clamped.try_cast("decimal(4,1)"))
