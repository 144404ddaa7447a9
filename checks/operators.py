"""Registered queries of the single operators."""

from __future__ import annotations

import dataclasses
import uuid
from datetime import date

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import (
    BOXES, Query, RECENT, REPEAT_YEARS, shown, study_density, study_facts, study_personality, study_survival,
    study_trials, tables,
)
from vitalrates.functions import casting, coordinates, dates
from vitalrates.operators import (
    effects, grouped, joins, ranking, resample, residual_checks, residuals, rows, scores, sequences,
)
from vitalrates.operators.lasso import coordinate_descent, cross_products
from vitalrates.operators.mixed import MixedFit, fit_mixed_logit
from vitalrates.plans import analysis, birthdate, cones, density, figures, litters, survival, trials
from vitalrates.session import cut_lineage, ensure_checkpoint_dir, freed_shuffles
from vitalrates.sources import models
from vitalrates.sources.standins import standin
from vitalrates.sources.tables import query_text, read_table_csv, scan_between, write_table_csv

C = F.col
#: Days after the order from which a line counts as shipped late.
LATE_DAYS = 60


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"


# --- sources and sinks

def s1(spark, sf):
    source = study_trials(spark, sf).select("squirrel_id", "sex", "year", "comments", "walk", "trialdate", "n1_weight",
                                            "row_idx")
    path = scratch(spark, "trials")
    write_table_csv(source, path)
    return shown(read_table_csv(spark, path, source.schema))


def s2(spark, sf):
    source = standin(spark, sf, "litter")
    path = scratch(spark, "litter")
    write_table_csv(source, path)
    return shown(read_table_csv(spark, path, source.schema).groupBy("grid").agg(
        F.count("*").alias("n"), F.count("fieldBDate").alias("dated"), F.max("date1").alias("latest")
    ))


def s4(spark, sf):
    return shown(scan_between(standin(spark, sf, "litter"), "date1", date(1997, 1, 1), date(1999, 1, 1), ["id", "date1"]))


def s5(spark, sf):
    return shown(survival.autumn_census(*tables(spark, sf, "pup_census", "pup_census_next"), RECENT))


def s6(spark, sf):
    training = litters.litter_training_rows(*tables(spark, sf, "pup_juvenile", "pup_litter"))
    dated = training.filter("part is not null")
    roles = birthdate.Roles()
    model = birthdate.final_model(dated, roles, birthdate.level_lists(dated, roles), 0.1)
    path = scratch(spark, "model")
    models.save_model(model, path)
    both = birthdate.predict(models.load_model(path), birthdate.predict(model, training, roles, "before"), roles, "after")
    return both.select("litter_id", C("before").eqNullSafe(C("after")).alias("same"))


def s6_mixed(spark, sf):
    """Link predictions of a stored fit, read by another session."""
    design, path = given_design(spark, sf), scratch(spark, "fit")
    design.rows.write.parquet(f"{path}/rows")
    models.save_mixed_fit(spark, given_fit(design, {"dam_id": dam_walks(design.rows)}), f"{path}/fit")
    fresh = spark.newSession()
    fit = models.load_mixed_fit(fresh, f"{path}/fit")
    linked = effects.link_predictions(fresh.read.parquet(f"{path}/rows"), fit, {"dam_id": "dam_id"})
    return shown(linked.select("row_idx", "squirrel_id", "link"), digits=4)


def s7(spark, sf):
    """A stored query text over named tables, with a parameter."""
    path = scratch(spark, "query")
    text = """select Grid as grid, count(*) as n, sum(NumNew) as total
from {cones} where NumNew > :least group by Grid
having count(*) > 1;
"""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return shown(query_text(spark, path, {"cones": standin(spark, sf, "cones")}, {"least": 10}))


def trial_sheet(spark, sf) -> DataFrame:
    """The trials as read from a sheet of several CSV files, numbered in file order."""
    sheet = standin(spark, sf, "trials")
    path = scratch(spark, "sheet")
    write_table_csv(sheet.repartitionByRange(8, "row_idx").sortWithinPartitions("row_idx"), path)
    return read_table_csv(spark, path, sheet.schema, row_number="line")


def s1_numbered(spark, sf):
    return shown(trial_sheet(spark, sf).select("row_idx", "line", "observer"))


def s8(spark, sf):
    return shown(rows.column_overview(standin(spark, sf, "litter"))).drop("column_type")


# --- projections

def p1(spark, sf):
    return shown(rows.select_renamed(
        standin(spark, sf, "trials"), [("squirrel_id", "sq_id"), "year", "observer", "year", "walk", "row_idx"]
    ))


def p2(spark, sf):
    return shown(rows.clean_names(standin(spark, sf, "pup_trials"))).select(
        "sq_id", "exclude_unless_video_reanalyzed", "proceed_with_caution", "oft_duration", "row_idx"
    )


def p5(spark, sf):
    return shown(standin(spark, sf, "cones").withColumns({
        "cone_index": cones.cone_index(C("NumNew")), "total_cones": cones.total_cones(C("NumNew")),
    }), digits=4)


def p6(spark, sf):
    c = standin(spark, sf, "census")
    kind = C("squirrel_id") % 7
    odd = (F.when(kind == 0, F.concat(F.lit("-"), "locy")).when(kind == 1, F.concat(C("locy"), F.lit("abc")))
           .when(kind == 2, F.lit("9" * 25)).when(kind == 3, F.concat(F.lit("x"), "locy"))
           .when(kind == 4, F.concat(F.lit("  +"), "locy")).when(kind == 5, F.lit("-" + "9" * 25)))
    return shown(c.select(
        "squirrel_id", "locx", "locy", casting.to_tenths(C("locy")).alias("tenths"),
        casting.to_unsigned(C("locy")).alias("unsigned"), casting.to_unsigned(odd).alias("odd_unsigned"), casting.to_tenths(C("locx")).alias("text_tenths"),
        casting.truncate_to_int(C("locy").cast("double") - 12.75).alias("whole"),
        C("squirrel_id").cast("string").alias("id_text"), (C("sex") == "M").cast("int").alias("male"),
    ))


def p7(spark, sf):
    c = standin(spark, sf, "cones")
    return shown(c.select(
        "Grid", "Year", "NumNew", F.when(C("Year").isin(1998, 2000), 1).otherwise(0).alias("mast"),
        F.when(cones.is_fed(C("Grid"), C("Year"), (("AG", 1996, 1999), ("LL", 1997, 1998))), "f").otherwise("c").alias("exp"),
    ))


def p7_flag(spark, sf):
    seen = standin(spark, sf, "last_seen")
    longevity = dates.days_between(C("datee"), C("fieldBDate"))
    return shown(seen.select(
        "litter_id", longevity.alias("longevity"),
        F.when((C("byear") < 2001) & (longevity >= 200), True).otherwise(False).alias("survived_200d"),
    ))


def p11(spark, sf):
    c = standin(spark, sf, "census")
    return shown(c.select("locx", coordinates.grid_coordinate(C("locx")).alias("x"),
                          coordinates.grid_coordinate(F.lower("locx")).alias("x_lower"),
                          coordinates.grid_coordinate(C("locx"), True).alias("x_strict"),
                          coordinates.database_tenths(C("locy")).alias("y_strict")))


def p13(spark, sf):
    c = standin(spark, sf, "juvenile")
    return shown(c.select("litter_id", "squirrel_id", F.log(C("weight") + 1).alias("log_weight"),
                          F.exp(C("weight") / 50).alias("exp_weight"),
                          casting.divide(F.log("tagWT"), C("weight") - 20).alias("ratio")), digits=5)


def p14(spark, sf):
    return shown(standin(spark, sf, "litter").select(
        "id", F.year("date1").alias("year"), F.month("date1").alias("month"), dates.day_of_year(C("date1")).alias("day"),
        dates.day_of_year(C("fieldBDate")).alias("part"),
    ))


def p17(spark, sf):
    return shown(standin(spark, sf, "trials").select("row_idx", dates.parse_short_date(C("trialdate")).alias("trialdate")))


def p19(spark, sf):
    return shown(casting.fill_missing(standin(spark, sf, "trials"), {"walk": 0.0}).select(
        "row_idx", "walk", F.lit(1).alias("made_it"), F.lit(2021).alias("census_year")))


def p21(spark, sf):
    t = standin(spark, sf, "pup_trials")
    by_text = ranking.factor_levels(t, "Taglft", "row_idx").select(C("level").alias("level"), "code", F.lit("taglft").alias("factor"))
    by_number = ranking.factor_levels(t, "Year").select(C("level").cast("string").alias("level"), "code", F.lit("year").alias("factor"))
    return shown(by_text.unionByName(by_number))


def p22(spark, sf):
    r = standin(spark, sf, "juvenile").agg(F.min("tagWT").alias("lo"), F.max("tagWT").alias("hi")).first()
    return shown(sequences.spaced(spark, r["lo"], r["hi"], 500, "x"))


def p23(spark, sf):
    t = standin(spark, sf, "trials").select("row_idx", "walk", casting.inverse_logit(C("walk") / 100 - 1).alias("p"))
    return shown(t.withColumn("eta", casting.logit(C("p"))).drop("walk"))


# --- filters

def f1(spark, sf):
    t = rows.clean_names(standin(spark, sf, "pup_trials"))
    return shown(t.filter((C("ageclass") == "J") & (C("proceed_with_caution") == "N") & (C("observer") != "SWK")).select("row_idx"))


def f2(spark, sf):
    c = standin(spark, sf, "cones")
    return shown(c.filter(C("Grid").isin("AG", "CH", "BT") & C("Year").between(1997, 1999) & C("NumNew").isNotNull()
                          & (C("NumNew") > 10)).groupBy("Grid", "Year").agg(F.count("*").alias("n")))


def f6(spark, sf):
    located = density.located_records(*tables(spark, sf, "dbamidden", "census"))
    placed = density.placed_records(located)
    return shown(density.counted_by_rule(placed, BOXES).groupBy("grid", "year").agg(
        F.count("*").alias("records"), F.sum("locx").alias("sum_x")))


def f7(spark, sf):
    t = standin(spark, sf, "trials")
    return shown(grouped.keep_first_trials(t, ["sq_id", "year"], (2017, 2018), "ARM", "row_idx",
                                           joins.hot_keys(t, "sq_id")).select("row_idx", "observer", "trialnumber"))


def f7_csv(spark, sf):
    t = trial_sheet(spark, sf)
    return shown(grouped.keep_first_trials(t, ["sq_id", "year"], (2017, 2018), "ARM", "line",
                                           joins.hot_keys(t, "sq_id")).select("row_idx", "observer", "trialnumber"))


def f8(spark, sf):
    t = rows.clean_names(standin(spark, sf, "pup_trials"))
    return shown(rows.complete_cases(t, ["sq_id", "walk", "hang", "comments"]).select("row_idx"))


def f9(spark, sf):
    return shown(trials.missing_birth_dates(study_trials(spark, sf)))


# --- joins

def j1(spark, sf):
    pups = standin(spark, sf, "juvenile")
    return shown(grouped.group_size(pups, "litter_id", "squirrel_id", "litter_size", joins.hot_keys(pups, "litter_id")))


def j2(spark, sf):
    pups, nests = tables(spark, sf, "juvenile", "litter")
    nests = nests.filter("id % 3 = 0").select(C("id").alias("litter_id"), "grid")
    out = joins.left_join(pups, nests, ["litter_id"], null_safe=False, hot=joins.hot_keys(pups, "litter_id"),
                          spread_by=["squirrel_id"])
    return shown(out.select("squirrel_id", "litter_id", "grid"))


def j3(spark, sf):
    pups, nests = tables(spark, sf, "juvenile", "pup_litter")
    out = joins.left_join(pups, nests.select(C("id").alias("litter_id"), "date1"), ["litter_id"], null_safe=False)
    return shown(out.filter("date1 is not null").select("squirrel_id", "litter_id", "date1"))


def j4(spark, sf):
    t = rows.clean_names(standin(spark, sf, "pup_trials")).select(C("sq_id").alias("squirrel_id"), "row_idx")
    facts = standin(spark, sf, "pup_juvenile")
    return shown(joins.left_join(t, facts, ["squirrel_id"], hot=joins.hot_keys(t, "squirrel_id"),
                                 spread_by=["row_idx"]))


def j5(spark, sf):
    left = study_trials(spark, sf).select("squirrel_id", "litter_id", "dam_id", "row_idx", C("n2_date").alias("datee"))
    right = standin(spark, sf, "pup_last_seen").select("squirrel_id", "litter_id", "dam_id", "datee", "f2")
    return shown(joins.left_join(left, right, ["squirrel_id", "litter_id", "dam_id"], suffixes=("_per", "_fla"),
                                 hot=joins.hot_keys(standin(spark, sf, "pup_trials"), "Sq ID"), spread_by=["row_idx"]))


def j6(spark, sf):
    seen = standin(spark, sf, "pup_last_seen").select("squirrel_id", "byear", "f1")
    census = survival.autumn_census(*tables(spark, sf, "pup_census", "pup_census_next"), RECENT)
    return shown(joins.left_join(seen, census, ["squirrel_id", ("byear", "census_year")],
                                 hot=joins.hot_keys(seen, "squirrel_id"), spread_by=["f1"]))


def j7(spark, sf):
    t = rows.clean_names(standin(spark, sf, "pup_trials")).select("row_idx", "grid", "year")
    return shown(survival.attach_density(t, study_density(spark, sf)))


# --- aggregates, windows, ordering, sets

def a1(spark, sf):
    return shown(standin(spark, sf, "cones").groupBy("Grid").agg(
        F.sum("NumNew").alias("total"), F.avg("NumNew").alias("mean"), F.count("NumNew").alias("counted")))


def a5(spark, sf):
    out = figures.survival_rates(
        study_trials(spark, sf).withColumn("made_it", (C("part") > 180).cast("int")).filter("made_it is not null"),
        "made_it", (RECENT,))
    return shown(out)


def a6(spark, sf):
    j = standin(spark, sf, "juvenile")
    got = ranking.exact_medians(j, ["weight", "tagWT"])
    t = ranking.exact_medians(standin(spark, sf, "trials"), ["walk", "jump"])
    return shown(spark.createDataFrame(
        [(got["weight"], got["tagWT"], t["walk"], t["jump"])], "weight double, tagwt double, walk double, jump double"))


def a7(spark, sf):
    return shown(standin(spark, sf, "juvenile").agg(
        F.min("weight").alias("lo"), F.max("weight").alias("hi"), F.avg("weight").alias("mean"),
        F.countDistinct("litter_id").alias("litters")))


def a8(spark, sf):
    j = standin(spark, sf, "juvenile")
    return shown(grouped.standardise(j, {"weight": "weight_sc"}).select("litter_id", "squirrel_id", "weight_sc"), digits=5)


def w1(spark, sf):
    t = standin(spark, sf, "trials")
    return shown(grouped.zscore_within(t, ["observer", "year"], {"walk": "walk_sc", "jump": "jump_sc"}).select(
        "row_idx", "walk_sc", "jump_sc"))


def w3(spark, sf):
    t = standin(spark, sf, "trials")
    return shown(grouped.first_value(t, ["sq_id", "year"], "observer", "row_idx"))


def w3_csv(spark, sf):
    return shown(grouped.first_value(trial_sheet(spark, sf), ["sq_id", "year"], "observer", "line"))


def o1(spark, sf):
    return shown(rows.order_desc(standin(spark, sf, "pup_juvenile"), "litter_id"))


def o2(spark, sf):
    c = standin(spark, sf, "cones").filter("NumNew is not null").groupBy("Year").agg(
        F.round(F.avg("NumNew"), 1).alias("metric"))
    return shown(rows.best_row(c, "metric", "Year"))


def u1(spark, sf):
    return shown(density.located_records(*tables(spark, sf, "dbamidden", "census"), distinct=True))


def u2(spark, sf):
    a = standin(spark, sf, "litter").select(C("id").alias("k"), "grid")
    b = standin(spark, sf, "pup_census").select(C("squirrel_id").alias("k"), "census_date")
    return shown(rows.bind_rows(a, b))


# --- birth-date model

def m1(spark, sf):
    litters_ = standin(spark, sf, "litter").select("id", "grid")
    train, test = resample.train_test_split(litters_, ["id"])
    return shown(train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test"))))


def m2(spark, sf):
    weighted = resample.bootstrap_weights(standin(spark, sf, "litter").select("id"), ["id"])
    return shown(weighted.select(F.posexplode("weights").alias("rep", "w")).groupBy("rep").agg(
        F.avg("w").alias("mean_weight"), F.avg((C("w") == 0).cast("double")).alias("out_of_bag")))


def m2_exact(spark, sf):
    """Every replicate draws as many rows as the table has."""
    drawn = resample.exact_bootstrap(standin(spark, sf, "trials").select("row_idx", "observer"), ["row_idx"])
    return shown(drawn.select(F.posexplode("weights").alias("rep", "w")).groupBy("rep").agg(
        F.count("*").alias("n_rows"), F.sum("w").alias("n_draws"), F.min((C("w") >= 0).cast("int")).alias("valid")))


def dated_rows(spark, sf):
    return litters.litter_training_rows(*tables(spark, sf, "pup_juvenile", "pup_litter")).filter("part is not null")


def m5(spark, sf):
    data = dated_rows(spark, sf)
    roles = birthdate.Roles()
    out, names = birthdate.design_columns(data, roles, birthdate.level_lists(data, roles))
    return shown(out.select("litter_id", "grid", "year", *names))


def m7(spark, sf):
    """One-predictor lasso fits at several penalties, from cross products."""
    data = dated_rows(spark, sf).dropna(subset=["n1_date"]).withColumn("w", F.array(F.lit(1)))
    products = cross_products(data, ["n1_date"], "part", "w", [0.0, 0.0])
    block = np.array([r["products"] for r in sorted(products.filter("bag = 0").collect(), key=lambda r: r["i"])])
    penalties = [0.1, 1.0, 10.0, 1000.0]
    fits = coordinate_descent(block, penalties)
    return shown(spark.createDataFrame(
        [(p, float(a), float(b)) for p, (a, b) in zip(penalties, fits)], "penalty double, intercept double, slope double"
    ), digits=4)


def m9(spark, sf):
    training = dated_rows(spark, sf)
    return birthdate.tune(training, birthdate.Roles(), birthdate.level_lists(training, birthdate.Roles()))


def m11(spark, sf):
    """Hold-out measures of a given linear prediction."""
    line = SQLTransformer(statement="SELECT *, 10.0D + 0.9D * n1_date + 0.05D * n1_weight AS pred FROM __THIS__")
    roles = dataclasses.replace(birthdate.Roles(), factors=())
    found = birthdate.holdout_metrics(PipelineModel(stages=[line]), dated_rows(spark, sf), roles)
    return shown(spark.createDataFrame([(found["rmse"], found["r2"])], "rmse double, r2 double"))


def m12(spark, sf):
    """Predictions are NULL exactly where a number is missing or a level was not trained on."""
    training = dated_rows(spark, sf)
    roles = birthdate.Roles()
    model = birthdate.final_model(training, roles, birthdate.level_lists(training, roles), 0.5)
    scored = birthdate.predict(model, study_trials(spark, sf), roles)
    return shown(scored.select("row_idx", "squirrel_id", C("pred").isNotNull().alias("predicted")))


def m13(spark, sf):
    """Known birth days survive imputation unchanged."""
    training = dated_rows(spark, sf)
    roles = birthdate.Roles()
    model = birthdate.final_model(training, roles, birthdate.level_lists(training, roles), 0.5)
    cleaned = study_trials(spark, sf).withColumn("known", C("part"))
    filled = birthdate.impute_birth_dates(cleaned, model, roles)
    return shown(filled.select("row_idx", "squirrel_id", F.when(C("known").isNotNull(), C("part")).alias("part"),
                               C("part").isNotNull().alias("filled")))


# --- scores and survival models

def unimputed(spark, sf) -> DataFrame:
    return cut_lineage(study_personality(spark, sf))


def scored_rows(spark, sf) -> DataFrame:
    return analysis.behaviour_scores(unimputed(spark, sf))


def d1(spark, sf):
    t = rows.clean_names(standin(spark, sf, "pup_trials")).select("row_idx", "walk", "hang", "attack")
    return shown(ranking.fill_medians(t, ["walk", "hang", "attack"]))


def d2(spark, sf):
    t = standin(spark, sf, "trials")
    return shown(scores.add_scores(t, {"score": ("walk", "jump")}).select("row_idx", "score"), digits=5)


def d2_correlations(spark, sf):
    t = rows.clean_names(standin(spark, sf, "pup_trials"))
    return shown(scores.correlations(t, ["front", "back", "attacklatency", "approachlatency", "still"]))


def given_design(spark, sf) -> analysis.Design:
    return analysis.survival_design(scored_rows(spark, sf), "made_it", (1999,))


def g1(spark, sf):
    design = given_design(spark, sf)
    return shown(design.rows.select("row_idx", "squirrel_id", *design.columns), digits=4)


def g2_plain(spark, sf):
    data = rows.clean_names(standin(spark, sf, "pup_trials")).select(
        (C("sex") == "M").cast("double").alias("male"), (C("walk") > 20).cast("double").alias("y")).dropna()
    return shown(effects.fit_plain_logit(data, "y", ["male"]).drop("p"), digits=4)


def g2_mixed(spark, sf):
    """A joint fit with crossed and nested intercepts: which order lines are shipped late, by season, supplier and part of
    the supplier. Complete lines whose order is known take part."""
    placed = spark.read.parquet(f"{sf}/orders.parquet").groupBy(C("o_orderkey").alias("l_orderkey")).agg(
        F.min("o_orderdate").alias("ordered"))
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_shipdate", F.lit(1.0).alias("constant"), (C("l_quantity").cast("double") / 50).alias("quantity"),
        C("l_discount").cast("double").alias("discount"), F.month("l_shipdate").alias("season"), C("l_suppkey").alias("supplier"),
        F.concat(C("l_suppkey").cast("string"), F.lit("/"), C("l_partkey").cast("string")).alias("part"))
    late = lines.join(placed, "l_orderkey").withColumn(
        "late", (F.datediff("l_shipdate", "ordered") > LATE_DAYS).cast("double")).drop("l_orderkey", "l_shipdate", "ordered")
    fit = fit_mixed_logit(late.dropna(), "late", ["constant", "quantity", "discount"], ["season", "supplier", "part"])
    return rows.bind_rows(
        effects.fixed_effects(spark, fit).select(C("term").alias("name"), C("estimate").alias("value"), "std_error"),
        effects.random_effects(spark, fit).select(C("grouping").alias("name"), C("sd").alias("value")))


def g2_crossed(spark, sf):
    """Score equations at a fit with crossed suppliers and parts: the residuals of a level balance its effect."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.lit(1.0).alias("constant"), (C("l_quantity").cast("double") / 50).alias("quantity"),
        C("l_suppkey").cast("string").alias("supplier"), C("l_partkey").cast("string").alias("part"),
        (C("l_returnflag") == "R").cast("double").alias("returned"))
    sds = {"supplier": 0.4, "part": 0.3}
    fit = fit_mixed_logit(items, "returned", ["constant", "quantity"], list(sds), sds=sds, tolerance=1e-12)
    with freed_shuffles(spark):
        linked = effects.link_predictions(items, fit, {g: g for g in sds}).withColumn(
            "rest", C("returned") - casting.inverse_logit(C("link")))
        # All sums come from one pass, so that the rows are joined with their effects once.
        every = 2 ** len(sds) - 1
        sums = cut_lineage(linked.groupingSets([[], *[[g] for g in sds]], *sds).agg(
            F.sum("rest").alias("constant"), F.sum(C("rest") * C("quantity")).alias("quantity"), F.grouping_id().alias("left_out")))
        parts = [sums.filter(C("left_out") == every).select(
            F.lit("fixed").alias("factor"), F.expr("stack(2, 'constant', constant, 'quantity', quantity) as (level, gap)"))]
        for i, (g, sd) in enumerate(sds.items()):
            own = sums.filter(C("left_out") == every - 2 ** (len(sds) - 1 - i)).select(C(g).alias("level"), C("constant").alias("gap"))
            parts.append(own.join(fit.effects[g], "level", "full").select(
                F.lit(g).alias("factor"), "level", (C("gap") - C("effect") / sd**2).alias("gap")))
        return rows.bind_rows(*parts).select("factor", "level", (F.abs(C("gap")) < 1e-3).alias("balanced"))


def given_fit(design: analysis.Design, tables_: dict[str, DataFrame] | None = None) -> MixedFit:
    count = len(design.columns)
    beta = np.array([0.1 * (i % 5) - 0.2 for i in range(count)])
    return MixedFit(design.columns, beta, np.eye(count), {}, tables_ or {}, 0.0, 0, {}, 0)


def dam_walks(rows_: DataFrame) -> DataFrame:
    """A stand-in for fitted dam effects: the mean walk of each dam's young."""
    return rows_.groupBy(C("dam_id").cast("string").alias("level")).agg(F.avg("walk").alias("effect"))


def g4(spark, sf):
    """Term tests of given coefficients with the covariance of the design columns."""
    design = given_design(spark, sf)
    names = ["part_rel", "density", "part_x_density"]
    row = design.rows.agg(*[F.covar_samp(a, b).alias(f"c{i}{j}") for i, a in enumerate(names) for j, b in enumerate(names)])
    first = row.first()
    covariance = np.array([[first[f"c{i}{j}"] for j in range(3)] for i in range(3)])
    fit = MixedFit(names, np.array([0.4, -0.3, 0.2]), covariance, {}, {}, 0.0, 0, {}, 0)
    terms = {"part": ["part_rel"], "density": ["density"], "part:density": ["part_x_density"]}
    return shown(effects.wald_tests(spark, fit, terms).drop("p"), digits=5)


def g5(spark, sf):
    design = given_design(spark, sf)
    curve = figures.response_curve(design, given_fit(design)).filter("source = 'curve'")
    return shown(curve.drop("source"), digits=5)


def g6(spark, sf):
    design = given_design(spark, sf)
    fit = given_fit(design, {"dam_id": dam_walks(design.rows)})
    return shown(effects.link_predictions(design.rows, fit, {"dam_id": "dam_id"}).select("row_idx", "squirrel_id", "link"), digits=4)


def g7(spark, sf):
    t = standin(spark, sf, "trials").select((C("walk") / 500.0).alias("u"))
    return shown(ranking.uniformity_distance(t, "u"))


def g7_residuals(spark, sf):
    design = given_design(spark, sf)
    linked = design.rows.withColumn("link", effects.fixed_part(design.columns, given_fit(design).beta))
    out = residuals.quantile_residuals(linked, "made_it", "link", ["row_idx"])
    edge = 1.0 - casting.inverse_logit(C("link"))
    return out.select("row_idx", "squirrel_id", (C("residual") >= edge).alias("above"),
                      (F.round(C("residual_normal"), 9).isNotNull()).alias("finite"))


def drawn_residuals(spark, sf) -> DataFrame:
    """Residuals of a given prediction of returns, drawn from an md5 of the row key."""
    key = F.md5(F.concat_ws("|", C("l_orderkey").cast("string"), C("l_linenumber").cast("string")))
    draw = (F.conv(F.substring(key, 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", (C("l_returnflag") == "R").cast("int").alias("returned"),
        (C("l_extendedprice").cast("double") / 50000 - 1).alias("link"), draw.alias("draw"))
    return residuals.quantile_residuals(items, "returned", "link", draw=C("draw"))


def g7_values(spark, sf):
    return shown(drawn_residuals(spark, sf).select("l_orderkey", "l_linenumber", "residual"))


def g7_trend(spark, sf):
    return shown(residual_checks.residual_trend(drawn_residuals(spark, sf), "link", "residual"), digits=5)


def g7_tests(spark, sf):
    return shown(residual_checks.residual_tests(drawn_residuals(spark, sf), "returned", "link", "residual").drop("p"), digits=5)


def q9(spark, sf):
    return shown(scored_rows(spark, sf).select("row_idx", "squirrel_id", "growth_sc", "part_sc", "oft1", "mis1", "survival"), digits=5)


def t1(spark, sf):
    return shown(figures.survival_rates(given_design(spark, sf).rows, "made_it", (RECENT,)))


def t2(spark, sf):
    return shown(figures.normal_ellipse(scored_rows(spark, sf), "oft1", "mis1").table(spark), digits=4)


def t2_robust(spark, sf):
    return figures.robust_ellipse(scored_rows(spark, sf), "oft1", "mis1").outline(spark, "oft1", "mis1")


def t3(spark, sf):
    design = given_design(spark, sf)
    return shown(figures.response_curve(design, given_fit(design)).filter("source = 'observed'"), digits=5)


def t4(spark, sf):
    design = given_design(spark, sf)
    fit = given_fit(design, {"dam_id": dam_walks(design.rows)})
    return shown(figures.density_links(effects.link_predictions(design.rows, fit, {"dam_id": "dam_id"})), digits=4)


# --- whole studies with fitted models

def imputed(spark, sf) -> DataFrame:
    training = litters.litter_training_rows(*tables(spark, sf, "pup_juvenile", "pup_litter"))
    fit = birthdate.fit_birth_date_model(training)
    return birthdate.impute_birth_dates(study_trials(spark, sf), fit.model)


def q6(spark, sf):
    return shown(imputed(spark, sf).select("row_idx", "squirrel_id", "litter_id", "part"))


def model_report(spark, design: analysis.Design) -> DataFrame:
    """Fixed effects, deviations, term tests and the fit of a survival model in one table."""
    # Litters of the stand-in tables are nearly all alike, where the joint minimum takes hundreds of scans; G2_mixed_fit has it.
    fit = analysis.fit_survival(design, joint=False)
    parts = [
        effects.fixed_effects(spark, fit).select(
            F.lit("fixed").alias("section"), C("term").alias("name"), C("estimate").alias("value"), "std_error", "p"),
        effects.random_effects(spark, fit).select(
            F.lit("random").alias("section"), C("grouping").alias("name"), C("sd").alias("value")),
        analysis.term_tests(design, fit).select(
            F.lit("test").alias("section"), C("term").alias("name"), C("chi_square").alias("value"), "p"),
        effects.model_summary(spark, fit).select(
            F.lit("summary").alias("section"), F.lit("aic").alias("name"), C("aic").alias("value")),
        ranking.uniformity_distance(analysis.residual_table(design, fit), "residual").select(
            F.lit("residuals").alias("section"), F.lit("ks").alias("name"), C("ks").alias("value")),
    ]
    return rows.bind_rows(*parts)


def full_scored(spark, sf) -> DataFrame:
    return analysis.behaviour_scores(cut_lineage(study_personality(spark, sf, imputed(spark, sf))))


def q10(spark, sf):
    with freed_shuffles(spark):
        return model_report(spark, analysis.autumn_design(full_scored(spark, sf), (1999,)))


def q11(spark, sf):
    with freed_shuffles(spark):
        return model_report(spark, analysis.days200_design(full_scored(spark, sf)))


OPERATORS: dict[str, Query] = {
    "S1_csv_round_trip": s1, "S2_csv_sink": s2, "S4_range_scan": s4, "S5_second_namespace": s5,
    "S6_model_reload": s6, "S6_mixed_fit_reload": s6_mixed, "S7_stored_query": s7, "S8_column_overview": s8, "S1_numbered_csv": s1_numbered,
    "P1_select_rename": p1, "P2_clean_names": p2, "P5_computed_columns": p5, "P6_casts": p6, "P7_case_when": p7,
    "P7_P18_survival_flag": p7_flag, "P8_P11_grid_coordinate": p11, "P12_P13_arithmetic": p13, "P14_P16_date_parts": p14,
    "P17_short_dates": p17, "P19_P20_defaults": p19, "P21_factor_levels": p21, "P22_sequence": p22, "P23_logit": p23,
    "F1_conjunction": f1, "F2_F5_predicates": f2, "F6_region_rules": f6, "F7_repeat_trials": f7, "F7_repeat_trials_from_csv": f7_csv,
    "F8_complete_cases": f8, "F4_missing_birth_dates": f9,
    "J1_W2_group_size": j1, "J2_left_join": j2, "J3_left_join_present": j3, "J4_null_safe_join": j4,
    "J5_three_key_join": j5, "J6_renamed_keys": j6, "J7_dimension_join": j7,
    "A1_A4_group_totals": a1, "A5_group_rates": a5, "A6_medians": a6, "A3_A7_extremes": a7, "A8_M4_standardise": a8,
    "W1_group_zscores": w1, "W3_first_value": w3, "W3_first_value_from_csv": w3_csv, "O1_order_desc": o1, "O2_best_row": o2, "U1_union_distinct": u1,
    "U2_bind_rows": u2,
    "M1_split": m1, "M2_bootstrap": m2, "M2_exact_bootstrap": m2_exact, "M5_M6_dummies": m5, "M7_lasso": m7, "M9_tuning": m9,
    "M11_holdout": m11, "M12_scoring": m12, "M13_imputation": m13,
    "D1_median_fill": d1, "D2_component_pair": d2, "D2_correlations": d2_correlations,
    "G1_design": g1, "G2_G3_plain_logit": g2_plain, "G2_mixed_fit": g2_mixed, "G2_crossed_fit": g2_crossed, "G4_term_tests": g4, "G5_prediction_curve": g5,
    "G6_link_predictions": g6, "G7_uniformity": g7, "G7_residuals": g7_residuals,
    "G7_residual_values": g7_values, "G7_residual_trend": g7_trend, "G7_residual_tests": g7_tests,
    "Q6_imputed_birth_dates": q6, "Q9_behaviour_scores": q9, "Q10_autumn_survival": q10, "Q11_days200_survival": q11,
    "T1_survival_rates": t1, "T2_score_ellipse": t2, "T2_robust_ellipse": t2_robust, "T3_observed_outcomes": t3,
    "T4_density_links": t4,
}
