"""Missing-value aware joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalrates.session import LOOKUP_MAX_BYTES, cut_lineage, fits

Key = str | tuple[str, str]

HOT_SHARE = 0.01
SALT = "__salt"


def hot_keys(df: DataFrame, column: str, share: float = HOT_SHARE) -> list:
    """Every value of `column` above `share` of the rows, NULL among them, and possibly some colder ones; at most 1 / share.

    One pass over one column without a shuffle. The list only steers how rows are spread, never what a join returns.
    """
    items = df.select(column).stat.freqItems([column], share).first()[0] or []
    return list(items)


def _pairs(keys: Sequence[Key]) -> list[tuple[str, str]]:
    return [(k, k) if isinstance(k, str) else k for k in keys]


def _is_hot(c: Column, hot: Sequence) -> Column:
    known = F.coalesce(c.isin([v for v in hot if v is not None]), F.lit(False))
    return c.isNull() | known if None in hot else known


def salted_pair(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, hot: Sequence, slices: int, spread_by: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Spread hot keys of `left` over `slices` and repeat only those keys of `right` once per slice.

    The slice is a function of the columns `spread_by` alone: a task that is run again makes the same choice, filters
    go below it, and the scan reads no further column for it.
    """
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in spread_by]), F.lit(slices))
    left = left.withColumn(SALT, F.when(_is_hot(F.col(left_key), hot), spread).otherwise(F.lit(0)).cast("int"))
    copies = F.when(_is_hot(F.col(right_key), hot), F.sequence(F.lit(0), F.lit(slices - 1))).otherwise(
        F.array(F.lit(0))
    )
    return left, right.withColumn(SALT, F.explode(copies))


def join_slices(df: DataFrame) -> int:
    """Slices per hot key, following the parallelism of the session."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def left_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[Key],
    *,
    null_safe: bool = True,
    suffixes: tuple[str, str] = ("_x", "_y"),
    hot: Sequence | None = None,
    spread_by: Sequence[str] | None = None,
    slices: int | None = None,
    how: str = "left",
) -> DataFrame:
    """Left join (or another left-preserving `how`) keeping the left names of the key columns.

    `null_safe` lets NULL meet NULL, as data-frame joins do; without it keys compare as in SQL. Other columns present
    on both sides get `suffixes`. `hot` lists values of the first key worth spreading (see `hot_keys`) and `spread_by`
    left columns that tell the rows of such a key apart; without either the join relies on adaptive skew splitting.
    """
    pairs = _pairs(keys)
    value_columns = [c for c in right.columns if c not in {r for _, r in pairs}]
    left_names = {l for l, _ in pairs}
    shared = {c for c in value_columns if c in left.columns and c not in left_names}
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    renamed = {r: f"__key{i}" for i, (_, r) in enumerate(pairs)}
    right = right.select(
        *[F.col(r).alias(k) for r, k in renamed.items()],
        *[F.col(c).alias(c + suffixes[1] if c in shared else c) for c in value_columns],
    )
    salted = bool(hot and spread_by)
    if salted:
        by = [c + suffixes[0] if c in shared else c for c in spread_by]
        left, right = salted_pair(left, right, pairs[0][0], renamed[pairs[0][1]], hot, slices or join_slices(left), by)
        right = right.withColumnRenamed(SALT, "__copy")
    tests = [
        left[l].eqNullSafe(right[renamed[r]]) if null_safe else left[l] == right[renamed[r]] for l, r in pairs
    ]
    if salted:
        tests.append(left[SALT] == right["__copy"])
    joined = left.join(right, reduce(lambda a, b: a & b, tests), how)
    return joined.drop(*renamed.values(), SALT, "__copy")


def attach_small(
    left: DataFrame,
    table: DataFrame,
    keys: Sequence[Key],
    *,
    null_safe: bool = True,
    max_bytes: int = LOOKUP_MAX_BYTES,
    hot: Sequence | None = None,
    spread_by: Sequence[str] | None = None,
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Left join of a table expected to be small: stored, measured, then broadcast, or a shuffle above `max_bytes`."""
    stored = cut_lineage(table)
    if fits(stored, max_bytes):
        return left_join(left, F.broadcast(stored), keys, null_safe=null_safe, suffixes=suffixes)
    hot = hot_keys(left, _pairs(keys)[0][0]) if hot is None and spread_by else hot
    return left_join(left, stored, keys, null_safe=null_safe, suffixes=suffixes, hot=hot, spread_by=spread_by)
