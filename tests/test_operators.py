import random
import statistics

import pytest
from pyspark.sql import functions as F

from vitalrates.operators import grouped, joins, ranking, resample, rows
from vitalrates.session import fits


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_null_keys_meet(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k int, v string")
    expected = sorted([(1, "a", "x"), (1, "a", "y"), (None, "b", "z"), (3, "c", None)], key=repr)
    for hot in (None, [], [1], [None, 1]):
        assert values(joins.left_join(left, right, ["k"], hot=hot, spread_by=["v"], slices=3)) == expected
    plain = joins.left_join(left, right, ["k"], null_safe=False)
    assert plain.columns == ["k", "v_x", "v_y"]
    assert (None, "b", None) in values(plain)


def test_hot_keys_are_found_and_spread(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    hot = joins.hot_keys(df, "k")
    assert 7 in hot and len(hot) <= 100
    left, right = joins.salted_pair(df, df.select("k").distinct(), "k", "k", hot, 8, ["id"])
    sizes = [r["count"] for r in left.filter("k = 7").groupBy(joins.SALT).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * min(sizes)
    assert right.filter("k = 7").count() == 8
    joined = joins.left_join(df, df.groupBy("k").agg(F.count("*").alias("n")), ["k"], hot=hot, spread_by=["id"])
    assert joined.count() == 3000 and joined.filter("n is null").count() == 0


def test_attach_small_and_large_agree(spark):
    left = spark.range(500).select((F.col("id") % 7).alias("k"), "id")
    table = spark.range(6).select(F.col("id").alias("k"), (F.col("id") * 2).alias("d"))
    assert not fits(table, 60) and fits(table) and fits(table.limit(0), 0)
    assert values(joins.attach_small(left, table, ["k"])) == values(
        joins.attach_small(left, table, ["k"], max_bytes=60, spread_by=["id"]))


def test_null_may_be_a_hot_key(spark):
    df = spark.range(300).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), "id")
    hot = joins.hot_keys(df, "k")
    assert None in hot
    left, right = joins.salted_pair(df, df.select("k").distinct(), "k", "k", hot, 4, ["id"])
    assert left.filter("k is null").select(joins.SALT).distinct().count() == 4
    assert right.filter("k is null").count() == 4


def test_spread_join_keeps_pruning_and_pushdown(spark, sf_dir):
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    right = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    joined = joins.left_join(lines, right, ["l_orderkey"], null_safe=False, hot=[1, None], spread_by=["l_linenumber"])
    plan = joined.filter("l_tax > 0.04").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "l_tax" in line)
    assert "GreaterThan(l_tax" in scan and "ReadSchema: struct<l_orderkey:bigint,l_linenumber:" in scan
    assert "l_comment" not in scan and "l_quantity" not in scan


def test_zscores(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", None), ("b", 5.0), ("c", 4.0), ("c", 4.0), (None, 1.0), (None, 3.0)],
        "g string, x double",
    )
    out = {}
    for r in grouped.zscore_within(df, ["g"], {"x": "z"}).collect():
        out.setdefault(r["g"], []).append(r["z"])
    assert sorted(v for v in out["a"] if v is not None) == [-1.0, 0.0, 1.0] and None in out["a"]
    assert out["b"] == [None] and out["c"] == [None, None] and len(out[None]) == 2
    assert None not in out[None]


def test_repeat_trials_follow_the_first_row(spark):
    data = [
        (1, 2017, "ARM", 1, 0), (1, 2017, "OTH", 2, 1),   # first row ARM: only trial 1
        (2, 2017, "OTH", 1, 2), (2, 2017, "ARM", 2, 3),   # first row OTH: all
        (3, 2020, "ARM", 2, 4),                           # other year: all
        (None, 2018, "ARM", 2, 5), (None, 2018, "ARM", 1, 6), (4, 2018, "ARM", None, 7),
    ]
    df = spark.createDataFrame(data, "id int, year int, observer string, trialnumber int, pos int")
    kept = grouped.keep_first_trials(df, ["id", "year"], (2017, 2018), "ARM", "pos", hot=[1])
    assert sorted(r["pos"] for r in kept.collect()) == [0, 2, 3, 4, 6]


@pytest.mark.parametrize("seed", range(4))
def test_medians(spark, seed):
    rng = random.Random(seed)
    n = 997 + seed
    data = [
        (rng.choice([0.0, 1.0]), rng.gauss(0, 1e6), float(rng.randint(0, 4)), rng.random() if rng.random() < 0.5 else None)
        for _ in range(n)
    ]
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    got = ranking.exact_medians(df, ["a", "b", "c", "d"], bracket_rows=1)
    for i, c in enumerate("abcd"):
        assert got[c] == pytest.approx(statistics.median(r[i] for r in data if r[i] is not None), rel=1e-15)


def test_median_of_two_far_halves_and_of_nothing(spark):
    df = spark.createDataFrame([(0.0, None)] * 50 + [(1.0, None)] * 50, "a double, b double")
    assert ranking.exact_medians(df, ["a", "b"], bracket_rows=1) == {"a": 0.5, "b": None}


def test_levels_in_order_of_appearance(spark):
    df = spark.createDataFrame([("z", 0), ("b", 1), ("z", 2), ("a", 3), (None, 4)], "f string, pos int")
    assert values(ranking.factor_levels(df, "f", "pos")) == [("a", 3), ("b", 2), ("z", 1)]
    numbers = spark.createDataFrame([(2001,), (1996,), (2001,)], "y int")
    assert values(ranking.factor_levels(numbers, "y")) == [(1996, 1), (2001, 2)]


def test_uniformity(spark):
    us = [0.05, 0.1, 0.1, 0.5, 0.9]
    df = spark.createDataFrame([(u,) for u in us], "u double")
    n = len(us)
    expected = max(max((i + 1) / n - u, u - i / n) for i, u in enumerate(sorted(us)))
    assert ranking.uniformity_distance(df, "u").first()["ks"] == pytest.approx(expected)


def test_split_and_bootstrap(spark):
    df = spark.range(5000)
    train, test = resample.train_test_split(df, ["id"])
    assert train.intersect(test).count() == 0 and train.count() + test.count() == 5000
    assert 0.77 < train.count() / 5000 < 0.83
    again = resample.train_test_split(df.repartition(7), ["id"])[0]
    assert train.exceptAll(again).count() == 0
    weighted = resample.bootstrap_weights(df, ["id"], times=4)
    r = weighted.select(F.explode("weights").alias("w")).agg(
        F.avg("w").alias("m"), F.avg((F.col("w") == 0).cast("double")).alias("out"), F.var_samp("w").alias("v")).first()
    assert abs(r["m"] - 1) < 0.03 and abs(r["out"] - 0.3679) < 0.02 and abs(r["v"] - 1) < 0.06


def test_best_row_and_overview(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 9.0), (4.0, None)], "penalty double, rmse double")
    assert tuple(rows.best_row(df, "rmse", "penalty").first()) == (2.0, 5.0)
    view = {r["column_name"]: r for r in rows.column_overview(df).collect()}
    assert view["rmse"]["n_present"] == 3 and view["rmse"]["n_distinct"] == 2 and view["penalty"]["min_value"] == "1.0"
    with pytest.raises(ValueError):
        rows.require_complete(df, ["rmse"])


def test_overview_counts_long_and_odd_columns(spark):
    """Columns above the bound are counted by their own pass; names with dots, NULL columns and empty tables work."""
    df = spark.range(500).select(
        "id", (F.col("id") % 7).alias("a.b"), F.lit(None).cast("string").alias("none"),
        F.when(F.col("id") > 400, F.col("id") % 60).alias("some"))
    for small in (1, 50, 10_000):
        view = {r["column_name"]: r for r in rows.column_overview(df, small).collect()}
        assert {c: (r["n_present"], r["n_distinct"]) for c, r in view.items()} == {
            "id": (500, 500), "a.b": (500, 7), "none": (0, 0), "some": (99, 60)}
    assert view["id"]["max_value"] == "499" and view["none"]["min_value"] is None
    assert [r["n_distinct"] for r in rows.column_overview(df.limit(0)).collect()] == [0, 0, 0, 0]
