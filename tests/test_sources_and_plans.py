from datetime import date

import pytest
from pyspark.sql import functions as F

from checks import registry
from checks.operators import u1
from vitalrates.operators.rows import in_boxes
from vitalrates.plans import density, litters, survival
from vitalrates.rules import GRID_BOXES
from vitalrates.sources.standins import standin
from vitalrates.sources.tables import JdbcSource, query_text, read_table_csv, scan_between, write_stage, write_table_csv


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "a,b", 1.5, date(2020, 1, 2)), (2, None, None, None), (3, 'say "x"', -2.0, date(1999, 12, 31))],
        "id int, t string, x double, d date",
    )
    write_table_csv(df, str(tmp_path / "t"))
    back = read_table_csv(spark, str(tmp_path / "t"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert any("NA" in p.read_text() for p in (tmp_path / "t").glob("*.csv"))
    assert write_stage(df, str(tmp_path / "p")).count() == 3


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rows_are_numbered_in_file_order(spark, tmp_path, small_splits):
    expected, folder = [], tmp_path / "sheet"
    folder.mkdir()
    for k, n in enumerate([1, 400, 0, 7, 950, 30]):
        lines = [f"{k}-{i},{'x' * (i % 37)}" for i in range(n)]
        expected += [line.split(",")[0] for line in lines]
        (folder / f"part-{k}.csv").write_text("\n".join(["k,t", *lines]) + "\n")
    scan = read_table_csv(spark, str(folder), "k string, t string")
    assert scan.rdd.getNumPartitions() > 10
    out = read_table_csv(spark, str(folder), "k string, t string", row_number="line")
    got = {r["line"]: r["k"] for r in out.collect()}
    assert [got[i] for i in range(len(expected))] == expected and len(got) == len(expected)
    some = {r["line"]: r["k"] for r in out.filter("length(t) = 36").select("line", "k").collect()}
    assert some and all(expected[i] == k for i, k in some.items())
    with pytest.raises(ValueError):
        read_table_csv(spark, str(folder), "k string, t string", row_number="k")
    assert "Exchange hash" not in plan(out) and "Sort " not in plan(out)


def test_numbering_notices_changed_files(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("k\na\nb\n")
    out = read_table_csv(spark, str(tmp_path), "k string", row_number="line")
    path.write_text("k\na\nb\nc\n")
    with pytest.raises(Exception, match="files changed|does not exist|FILE_NOT_EXIST|modified"):
        spark.catalog.refreshByPath(str(tmp_path))
        out.collect()
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "a.csv").write_text("k\n")
    assert read_table_csv(spark, str(empty), "k string", row_number="line").count() == 0


def test_jdbc_options():
    source = JdbcSource("jdbc:mysql://db/study", properties={"user": "reader", "password": "x"})
    options = source.options(query="select 1 ; ", partition=("id", 0, 100, 8))
    assert options["dbtable"] == "(select 1) AS q" and options["numPartitions"] == "8"
    assert options["lowerBound"] == "0" and options["user"] == "reader" and "x" not in repr(source)
    assert source.options(table="census")["dbtable"] == "census"
    for wrong in ({}, {"table": "a", "query": "b"}):
        with pytest.raises(ValueError):
            source.options(**wrong)


def test_query_text_from_a_file(spark, tmp_path):
    path = tmp_path / "q.sql"
    path.write_text("select count(*) as n from {animals} where id > 2;\n")
    assert query_text(spark, str(path), {"animals": spark.range(5)}).first()["n"] == 2
    path.write_text("select id from {animals} where id = :wanted")
    assert [r["id"] for r in query_text(spark, f"file://{path}", {"animals": spark.range(5)}, {"wanted": 4}).collect()] == [4]
    (tmp_path / "other.sql").write_text("select 1")
    with pytest.raises(ValueError):
        query_text(spark, str(tmp_path / "*.sql"), {})


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    nests = scan_between(
        spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate", date(1997, 1, 1), date(1998, 1, 1), ["o_orderkey"])
    text = plan(nests)
    assert "GreaterThanOrEqual(o_orderdate" in text and "ReadSchema: struct<o_orderkey:bigint,o_orderdate" in text
    text = plan(density.population_density(
        *[standin(spark, sf_dir, n) for n in ("dbamidden", "census")], boxes=registry.BOXES))
    assert "GreaterThan(l_tax" in text and "l_discount" not in text


def test_plans_have_no_cross_product_and_no_row_udf(spark, sf_dir):
    for name in ("Q1_population_density", "Q2_cone_counts", "Q3_litter_training_rows", "Q4_litter_facts",
                 "Q5_clean_trials", "Q7_survival_facts", "Q8_density_on_trials"):
        text = plan(registry.QUERIES[name](spark, sf_dir))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "Window"):
            assert bad not in text, (name, bad)


def test_box_forms_agree(spark, sf_dir):
    placed = density.placed_records(density.located_records(
        *[standin(spark, sf_dir, n) for n in ("dbamidden", "census")]))
    c = F.col
    direct = placed.filter(in_boxes(F.month("date"), c("year"), c("grid"), c("locx"), c("locy"), registry.BOXES))
    ruled = density.counted_by_rule(placed, registry.BOXES)
    assert direct.count() == ruled.count() > 0
    assert direct.exceptAll(ruled).count() == 0
    assert len(GRID_BOXES) == 6


def test_union_all_gives_the_density_of_the_distinct_union(spark, sf_dir):
    distinct = u1(spark, sf_dir)
    assert distinct.count() < sum(standin(spark, sf_dir, n).count() for n in ("dbamidden", "census"))


def test_litter_sizes_differ_by_definition(spark):
    pups = spark.createDataFrame(
        [(1, 10, 5.0, 1.0), (1, 10, 6.0, 1.0), (2, 10, None, 1.0), (None, 10, 4.0, 1.0), (3, None, 4.0, 1.0)],
        "squirrel_id int, litter_id int, weight double, tagWT double")
    nests = spark.createDataFrame(
        [(10, "KL", date(2001, 4, 1), None, None, 7)],
        "id int, grid string, date1 date, fieldBDate date, tagDt date, squirrel_id int")
    training = litters.litter_training_rows(pups, nests).first()
    assert training["litter_size"] == 1 and training["n1_weight"] == 5.0 and training["part"] is None
    facts = litters.litter_facts(pups, nests, hot_litters=[10])
    assert facts.count() == 4 and {r["litter_size"] for r in facts.collect()} == {3}


def test_survival_rules(spark):
    trials = spark.createDataFrame(
        [(i, 1, 1, 200, 100, date(2000, 4, 1), date(2000, 4, 26), 10.0, 60.0) for i in range(6)],
        "squirrel_id int, litter_id int, dam_id int, julian_trialdate int, part int, fieldBDate date, n2_date date, "
        "n1_weight double, n2_weight double")
    seen = spark.createDataFrame(
        [(0, 2019, date(2001, 1, 1)), (1, 2019, date(2000, 5, 1)), (2, 2021, None), (3, 2021, None), (4, 2022, date(2009, 1, 1))],
        "squirrel_id int, byear int, datee date"
    ).selectExpr("squirrel_id", "cast(null as date) dates", "1 f1", "byear", "1 litter_id", "1 dam_id", "datee", "2 f2")
    census = spark.createDataFrame(
        [(1, date(2019, 8, 2)), (1, date(2019, 8, 9)), (0, date(2019, 7, 2)), (2, date(2021, 8, 1))],
        "squirrel_id int, census_date date")
    later = spark.createDataFrame([(3, date(2022, 5, 1)), (2, date(2023, 1, 1))], "squirrel_id int, census_date date")
    out = survival.survival_facts(trials, seen, census, later, hot_ids=[1], order="litter_id")
    got = sorted((r["squirrel_id"], r["made_it"], r["survived_200d"]) for r in out.collect())
    assert got == [(0, 0, True), (1, 1, False), (1, 1, False), (2, 0, False), (3, 1, True), (4, 0, False), (5, 0, False)]
    first = out.filter("squirrel_id = 0").first()
    assert first["age_at_trial"] == 100 and first["nest_days"] == 25.0 and first["growth"] == 2.0
    assert survival.survival_facts(trials, seen, census, later, dedupe=True).count() == 6
