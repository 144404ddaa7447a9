from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from vitalrates.functions.casting import divide, finite, to_unsigned, truncate_to_int
from vitalrates.functions.coordinates import database_tenths, grid_coordinate
from vitalrates.functions.dates import parse_short_date
from vitalrates.operators.rows import clean_names, select_renamed, snake_names
from vitalrates.operators.sequences import penalty_grid, spaced


def column(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def text(spark, values):
    return spark.createDataFrame([(v,) for v in values], "c string")


def test_coordinates_default(spark):
    df = text(spark, ["K.5", "a.2", "I.1", "3.4", "AB", "-0.2", "zz", None, "12345"])
    assert column(df, grid_coordinate(F.col("c"))) == [
        Decimal("11.5"), Decimal("1.2"), Decimal("9.1"), Decimal("3.4"), None, Decimal("-0.2"), None, None, None
    ]


def test_coordinates_as_the_database_reads_them(spark):
    df = text(spark, ["K.1", "K.5", "I.5", "I.1", "a.5", "1.5", "AB", "12345", None])
    assert column(df, grid_coordinate(F.col("c"), strict_compat=True)) == [
        Decimal("0.0"), Decimal("11.5"), Decimal("0.0"), Decimal("9.1"), Decimal("0.0"), Decimal("1.5"),
        Decimal("1.0"), Decimal("999.9"), None,
    ]
    assert column(text(spark, ["J1", "7.25x"]), database_tenths(F.col("c"))) == [Decimal("0.0"), Decimal("7.3")]


def test_short_dates(spark):
    df = text(spark, ["1/2/17", "1/2/70", "12/31/68", "02/30/17", "x", None])
    assert column(df, parse_short_date(F.col("c"))) == [
        date(2017, 1, 2), date(1970, 1, 2), date(2068, 12, 31), None, None, None
    ]


def test_casts_and_division(spark):
    df = spark.createDataFrame([(-3.7, 0.0), (float("nan"), 2.0), (5.9, 2.0)], "a double, b double")
    assert column(df, truncate_to_int(F.col("a"))) == [-3, None, 5]
    assert column(df, divide(F.col("b"), F.col("b"))) == [None, 1.0, 1.0]
    assert column(df, finite(F.col("a")) > 1) == [False, None, True]
    found = column(text(spark, ["7", "x", None, "3.7", " 12abc", "-1", "9" * 25]), to_unsigned(F.col("c")))
    assert found == [Decimal(7), Decimal(0), None, Decimal(3), Decimal(12), Decimal(2**64 - 1), Decimal(2**64 - 1)]


def test_names(spark):
    assert snake_names(["Sq ID", "sqID", "Proceed with caution?", "OFT duration", "2nd"]) == [
        "sq_id", "sq_id_2", "proceed_with_caution", "oft_duration", "x2nd"
    ]
    df = clean_names(spark.createDataFrame([(1, 2)], "`A b` int, `c` int"))
    assert select_renamed(df, [("x", "a_b"), "c", "c"]).columns == ["x", "c"]


def test_sequences(spark):
    values = column(spaced(spark, 1.0, 2.0, 5, "x"), "x")
    assert values == [1.0, 1.25, 1.5, 1.75, 2.0]
    grid = penalty_grid()
    assert len(grid) == 25 and abs(grid[0] - 1e-10) < 1e-20 and grid[-1] == 1.0
