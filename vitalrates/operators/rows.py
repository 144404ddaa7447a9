"""Row filters, column selection, row binding and ordering."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snake_names(names: Sequence[str]) -> list[str]:
    """snake_case names; a repeated name gets `_2`, `_3`, …"""
    result: list[str] = []
    seen: dict[str, int] = {}
    for name in names:
        text = name.replace("%", "_percent_").replace("#", "_number_").replace("'", "")
        text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
        text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", text)
        text = re.sub(r"[^0-9A-Za-z]+", "_", text).strip("_").lower() or "x"
        if text[0].isdigit():
            text = "x" + text
        seen[text] = seen.get(text, 0) + 1
        result.append(text if seen[text] == 1 else f"{text}_{seen[text]}")
    return result


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*snake_names(df.columns))


def select_renamed(df: DataFrame, columns: Sequence[str | tuple[str, str]]) -> DataFrame:
    """Columns in the given order; a pair is (new name, old name); a column listed twice is kept once."""
    picked: dict[str, Column] = {}
    for item in columns:
        new, old = (item, item) if isinstance(item, str) else item
        picked.setdefault(new, F.col(old).alias(new))
    return df.select(*picked.values())


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a missing value (NULL or NaN) in any of `columns`."""
    return df.dropna(subset=list(columns))


def require_complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`df` itself; raises when one of `columns` has a missing value."""
    missing = df.agg(
        *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns]
    ).first().asDict()
    bad = {c: n for c, n in missing.items() if n}
    if bad:
        raise ValueError(f"missing values: {bad}")
    return df


def in_boxes(month: Column, year: Column, grid: Column, x: Column, y: Column, boxes: Sequence) -> Column:
    """TRUE where a located record lies in the counted region of its grid; each grid has one region.

    The cheap tests come first and every bound is looked up by grid, so a coordinate that has to be parsed from text
    is parsed for the candidate records only and not once per region.
    """
    timed = []
    for box in boxes:
        test = (grid == box.grid) & (month == box.month)
        timed.append(test if box.after_year is None else test & (year > box.after_year))

    def bound(name: str) -> Column:
        chain = F
        for box in boxes:
            chain = chain.when(grid == box.grid, F.lit(getattr(box, name)))
        return chain

    inside = x.between(bound("x_lo"), bound("x_hi")) & y.between(bound("y_lo"), bound("y_hi"))
    return reduce(lambda a, b: a | b, timed) & inside


def bind_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all tables matched by column name; columns a table lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, first)


def union_distinct(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Distinct rows of all tables matched by position."""
    return reduce(lambda a, b: a.union(b), others, first).distinct()


def order_desc(df: DataFrame, key: str) -> DataFrame:
    """Rows by `key` descending, NULL last. The other columns break ties, which keeps range partitions even."""
    return df.orderBy(F.col(key).desc_nulls_last(), *[F.col(c) for c in df.columns if c != key])


def best_row(df: DataFrame, metric: str, tie_breaker: str) -> DataFrame:
    """The one row with the smallest `metric`; on a tie the larger `tie_breaker`."""
    rank = F.struct(F.col(metric), -F.col(tie_breaker))
    best = F.min_by(F.struct(*[F.col(c) for c in df.columns]), rank)
    return df.filter(F.col(metric).isNotNull()).agg(best.alias("best")).select("best.*")


def column_overview(df: DataFrame, small: int = 10_000) -> DataFrame:
    """One row per column: name, type, non-missing count, distinct count, smallest and largest value as text.

    The first scan gives counts, extremes and a mergeable sketch of the distinct values of every column. Columns that
    the sketch puts at most at `small` values are counted exactly in one more scan, from sets that tasks build and
    merge; each longer column is counted by a distinct pass that reads this column alone. Rows are never multiplied
    by columns, and a set stays near `small` values as the sketch errs by a few percent.
    """
    columns = df.columns
    types = dict(df.dtypes)
    quoted = {c: F.col(f"`{c}`") for c in columns}
    first = df.agg(*[
        F.struct(
            F.count(c).alias("n"), F.min(c).cast("string").alias("lo"), F.max(c).cast("string").alias("hi"),
            F.approx_count_distinct(c, 0.02).alias("about"),
        ).alias(f"c{i}")
        for i, c in enumerate(quoted.values())
    ]).first()
    stats = {c: first[f"c{i}"] for i, c in enumerate(columns)}
    short = [c for c in columns if stats[c]["about"] <= small]
    distinct: dict[str, int] = {}
    if short:
        sizes = df.agg(*[F.size(F.collect_set(quoted[c])).alias(f"c{i}") for i, c in enumerate(short)]).first()
        distinct = {c: sizes[f"c{i}"] for i, c in enumerate(short)}
    for c in columns:
        if c not in distinct:
            distinct[c] = df.select(quoted[c].alias("v")).filter("v is not null").distinct().count()
    rows = [(c, types[c], stats[c]["n"], distinct[c], stats[c]["lo"], stats[c]["hi"]) for c in columns]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, column_type string, n_present bigint, n_distinct bigint, min_value string, max_value string"
    )
