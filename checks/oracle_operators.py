"""Expected results of the operator queries as SQL."""

from __future__ import annotations

import string
from itertools import combinations

from checks.oracle import DENSITY, SURVIVAL, SURVIVAL_DENSITY, TRIALS, ctes, letter_number, training
from vitalrates.operators.resample import STEPS, poisson_limits
from vitalrates.rules import ACTIVITY, AGGRESSION

CENSI = SURVIVAL[-2]

NUMBER = r"^\s*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+))"


def database_decimal(text: str) -> str:
    return f"""case when {text} is null then null else cast(greatest(least(
    coalesce(try_cast(nullif(regexp_extract({text}, '{NUMBER}', 1), '') as double), 0.0), 999.9), -999.9)
    as decimal(4,1)) end"""


def unsigned(text: str) -> str:
    whole = f"coalesce(try_cast(nullif(regexp_extract({text}, '^\\s*([+-]?[0-9]+)', 1), '') as hugeint), 0)"
    return f"""case when {text} is null then null
  when {whole} < 0 then cast(greatest({whole}, -9223372036854775808::hugeint) + 18446744073709551616::hugeint as double)
  else cast(least({whole}, 18446744073709551615::hugeint) as double) end"""


STRICT_LETTERS = "case " + " ".join(
    f"when locx ilike '%{'1' if c == 'I' else c}%' then replace(locx, '{c}', '{i}')"
    for i, c in enumerate(string.ascii_uppercase, start=1)
) + " else locx end"

LITTER_ROWS = ("pup_juvenile", "pup_litter", *training("pup_juvenile", "pup_litter"),
    ("dated", "select * from training where part is not null"))


def component(name: str, columns: tuple[str, ...], source: str) -> tuple:
    """CTEs that end in {name}_loading(mu, sd, v): the leading eigenvector of the correlations by repeated squaring."""
    filled = ", ".join(f"coalesce({c}, (select median({c}) from {source})) as {c}" for c in columns)
    matrix = ", ".join(
        "[" + ", ".join("1.0::double" if a == b else f"corr({a}, {b})" for b in columns) + "]" for a in columns
    )
    return (
        (f"{name}_filled", f"select {filled} from {source}"),
        (f"{name}_moments", f"""select [{', '.join(f'avg({c})' for c in columns)}] as mu,
  [{', '.join(f'stddev_samp({c})' for c in columns)}] as sd, [{matrix}] as m from {name}_filled"""),
        (f"{name}_power", f"""select 0 as k, m as p from {name}_moments
union all
select k + 1, list_transform(p, lambda r: list_transform(p, lambda q: list_dot_product(r, q)
  / list_sum(list_transform(p, lambda t: list_dot_product(t, t))))) from {name}_power where k < 40"""),
        (f"{name}_loading", f"""select mu, sd, list_transform(p[1], lambda e: e / sqrt(list_dot_product(p[1], p[1]))
  * case when list_max(p[1]) >= -list_min(p[1]) then 1.0 else -1.0 end) as v
from {name}_power, {name}_moments where k = 40"""),
    )


def score_of(name: str, columns: tuple[str, ...], source: str) -> str:
    return "(select " + " + ".join(
        f"(coalesce(p.{c}, (select median({c}) from {source})) - mu[{i}]) / sd[{i}] * v[{i}]"
        for i, c in enumerate(columns, start=1)
    ) + f" from {name}_loading)"


SCORES = (
    *SURVIVAL_DENSITY, *component("act", ACTIVITY, "personality"), *component("agg", AGGRESSION, "personality"),
    ("scored", f"""select p.*, cast(survived_200d as int) as survival,
  (growth - avg(growth) over w) / nullif(stddev_samp(growth) over w, 0) as growth_sc,
  (part - avg(part) over w) / nullif(stddev_samp(part) over w, 0) as part_sc,
  {score_of('act', ACTIVITY, 'personality')} as oft1, {score_of('agg', AGGRESSION, 'personality')} as mis1
from personality p window w as (partition by grid, year)"""),
    ("complete", """select * from scored where year <> 1999 and made_it is not null and survival is not null
  and sex is not null and age_at_trial is not null and grid_density is not null and growth_sc is not null
  and part_sc is not null and oft1 is not null and mis1 is not null and grid is not null and year is not null
  and dam_id is not null and litter_id is not null"""),
    ("scaled", """select *, (age_at_trial - (select avg(age_at_trial) from complete))
    / (select stddev_samp(age_at_trial) from complete) as age,
  (grid_density - (select avg(grid_density) from complete))
    / (select stddev_samp(grid_density) from complete) as density_sc from complete"""),
    ("design", """select row_idx, squirrel_id, year, dam_id, made_it, grid_density, mis1 as mis1_raw, sex, walk,
  1.0::double as constant, case when sex = 'M' then 1.0::double else 0.0 end as "sexM", age, part_sc as part_rel,
  growth_sc as growth_rel, density_sc as density, oft1, mis1,
  case when grid = 'AG' then 1.0::double else 0.0 end as "gridAG",
  case when grid = 'CH' then 1.0::double else 0.0 end as "gridCH",
  case when grid = 'KL' then 1.0::double else 0.0 end as "gridKL",
  case when grid = 'LL' then 1.0::double else 0.0 end as "gridLL",
  part_sc * density_sc as part_x_density, growth_sc * density_sc as growth_x_density, oft1 * mis1 as oft1_x_mis1,
  oft1 * density_sc as oft1_x_density, mis1 * density_sc as mis1_x_density,
  oft1 * mis1 * density_sc as oft1_x_mis1_x_density from scaled"""),
)

# The order in which coefficients are numbered; the base grid is the first in the trials (SU).
DESIGN = (
    "constant", "sexM", "age", "part_rel", "growth_rel", "density", "oft1", "mis1", "gridAG", "gridCH", "gridKL",
    "gridLL", "part_x_density", "growth_x_density", "oft1_x_mis1", "oft1_x_density", "mis1_x_density",
    "oft1_x_mis1_x_density",
)


def beta(i: int) -> float:
    return round(0.1 * (i % 5) - 0.2, 10)


LINK = " + ".join(f'({beta(i)}::double) * "{c}"' for i, c in enumerate(DESIGN))


def recursive(*pairs) -> str:
    return ctes(*pairs).replace("with ", "with recursive ", 1)


def overview(table: str, columns: dict[str, str]) -> str:
    return "\nunion all\n".join(
        f"""select '{c}' as column_name, count({c}) as n_present, count(distinct {c}) as n_distinct,
  cast(min({c}) as varchar) as min_value, cast(max({c}) as varchar) as max_value from {table}"""
        for c in columns
    )


def dummies() -> str:
    grids = [f"g.levels[{i}]" for i in range(2, 6)]
    years = [f"y.levels[{i}]" for i in range(2, 8)]
    one = lambda test: f"case when {test} then 1.0::double else 0.0 end"
    terms = ["round(n1_weight, 6)", "round(n1_date, 6)", "cast(litter_size as double)"]
    terms += [one(f"grid = {g}") for g in grids] + [one(f"year = {v}") for v in years]
    terms += [one(f"grid = {g} and year = {v}") for g in grids for v in years]
    return ", ".join(f"{t} as x{i}" for i, t in enumerate(terms))


def draw(text: str, digits: int = 13) -> str:
    """The leading hex digits of an md5 as a whole number."""
    return f"cast('0x' || substr(md5({text}), 1, {digits}) as bigint)"


RESIDUALS = (
    ("items", f"""select l_orderkey, l_linenumber, cast(l_returnflag = 'R' as int) as y,
  l_extendedprice::double / 50000 - 1 as link,
  ({draw("l_orderkey || '|' || l_linenumber", 8)}::double + 0.5) / 4294967296.0::double as d from lineitem"""),
    ("drawn", """select *, 1 / (1 + exp(-link)) as mu,
  case when y = 1 then (1 - mu) + (1 - (1 - mu)) * d else (1 - mu) * d end as u from items"""),
    ("binned", """select *, ((upto - 1) * 20) // n as bin from (select *, count(*) over (order by link) as upto,
  count(*) over () as n from drawn)"""),
    ("trend", "\nunion all\n".join(f"""select bin, count(*) as n, min(link) as start, {p}::double as probability,
  quantile_cont(u, {p}) as quantile, avg((u < {p}::double)::int::double) as share_below,
  (sum((u < {p}::double)::int) - count(*) * {p}::double) / sqrt(count(*) * {p}::double * {1 - p}::double) as z
from binned group by bin""" for p in (0.25, 0.5, 0.75))),
)

STAT_COLUMNS = ("front", "back", "attacklatency", "approachlatency", "still")

SQL: dict[str, str] = {
    "S1_csv_round_trip": ctes(*TRIALS) + """select squirrel_id, sex, cast(year as bigint) as year, comments,
  round(walk, 6) as walk, cast(trialdate as varchar) as trialdate, round(n1_weight, 6) as n1_weight, row_idx
from cleaned""",
    "S2_csv_sink": ctes("litter") + """select grid, count(*) as n, count(fieldBDate) as dated,
  cast(max(date1) as varchar) as latest from litter group by grid""",
    "S4_range_scan": ctes("litter") + """select id, cast(date1 as varchar) as date1 from litter
where date1 >= date '1997-01-01' and date1 < date '1999-01-01'""",
    "S5_second_namespace": ctes("pup_census", "pup_census_next", CENSI) + """select squirrel_id,
  cast(census_year as bigint) as census_year, cast(made_it as bigint) as made_it from censi""",
    "S6_model_reload": ctes(*LITTER_ROWS) + "select litter_id, true as same from training",
    "S6_mixed_fit_reload": recursive(*SCORES) + f"""select row_idx, squirrel_id,
  round({LINK} + coalesce(avg(walk) over (partition by dam_id), 0), 4) as link from design""",
    "S7_stored_query": ctes("cones") + """select Grid as grid, count(*) as n, cast(sum(NumNew) as bigint) as total
from cones where NumNew > 10 group by Grid having count(*) > 1""",
    "S1_numbered_csv": ctes("trials") + """select row_idx, row_number() over (order by row_idx) - 1 as line, observer
from trials""",
    "S8_column_overview": ctes("litter") + overview("litter", dict.fromkeys(
        ("id", "grid", "date1", "fieldBDate", "tagDt", "squirrel_id"))),
    "P1_select_rename": ctes("trials") + """select sq_id as squirrel_id, year, observer, round(walk, 6) as walk, row_idx
from trials""",
    "P2_clean_names": ctes("pup_trials") + """select "Sq ID" as sq_id,
  "Exclude (unless video reanalyzed)" as exclude_unless_video_reanalyzed,
  "Proceed with caution" as proceed_with_caution, "OFT duration" as oft_duration, row_idx from pup_trials""",
    "P5_computed_columns": ctes("cones") + """select Grid as grid, cast(Year as bigint) as year, NumNew as numnew,
  round(ln(NumNew + 1), 4) as cone_index,
  round(1.11568::double * exp(0.1681::double + 1.1891::double * ln(NumNew + 0.01::double)), 4) as total_cones
from cones""",
    "P6_casts": ctes("census") + f"""select squirrel_id, locx, locy,
  cast(try_cast(locy as decimal(4,1)) as double) as tenths, {unsigned('locy')} as unsigned,
  {unsigned('odd')} as odd_unsigned,
  cast(try_cast(locx as decimal(4,1)) as double) as text_tenths,
  cast(trunc(cast(locy as double) - 12.75) as bigint) as whole, cast(squirrel_id as varchar) as id_text,
  cast(case when sex = 'M' then 1 else 0 end as bigint) as male
from (select *, case squirrel_id % 7 when 0 then '-' || locy when 1 then locy || 'abc' when 2 then '{'9' * 25}'
  when 3 then 'x' || locy when 4 then '  +' || locy when 5 then '-{'9' * 25}' end as odd from census)""",
    "P7_case_when": ctes("cones") + """select Grid as grid, cast(Year as bigint) as year, NumNew as numnew,
  cast(case when Year in (1998, 2000) then 1 else 0 end as bigint) as mast,
  case when Grid = 'AG' and Year between 1996 and 1999 then 'f'
       when Grid = 'LL' and Year between 1997 and 1998 then 'f' else 'c' end as exp from cones""",
    "P7_P18_survival_flag": ctes("last_seen") + """select litter_id,
  date_diff('day', fieldBDate, datee) as longevity,
  coalesce(byear < 2001 and date_diff('day', fieldBDate, datee) >= 200, false) as survived_200d from last_seen""",
    "P8_P11_grid_coordinate": ctes("census") + f"""select locx, cast({letter_number('upper(locx)')} as double) as x,
  cast({letter_number('upper(locx)')} as double) as x_lower,
  cast({database_decimal('(' + STRICT_LETTERS + ')')} as double) as x_strict,
  cast({database_decimal('locy')} as double) as y_strict from census""",
    "P12_P13_arithmetic": ctes("juvenile") + """select litter_id, squirrel_id, round(ln(weight + 1), 5) as log_weight,
  round(exp(weight / 50), 5) as exp_weight, round(ln(tagWT) / nullif(weight - 20, 0), 5) as ratio from juvenile""",
    "P14_P16_date_parts": ctes("litter") + """select id, year(date1) as year, month(date1) as month,
  dayofyear(date1) as day, dayofyear(fieldBDate) as part from litter""",
    "P17_short_dates": ctes("trials") + """select row_idx,
  cast(cast(strptime(trialdate, '%m/%d/%y') as date) as varchar) as trialdate from trials""",
    "P19_P20_defaults": ctes("trials") + """select row_idx, round(coalesce(walk, 0), 6) as walk,
  cast(1 as bigint) as made_it, cast(2021 as bigint) as census_year from trials""",
    "P21_factor_levels": ctes("pup_trials") + """select level, row_number() over (order by k) as code, 'taglft' as factor
from (select Taglft as level, min(row_idx) as k from pup_trials where Taglft is not null group by Taglft)
union all
select cast(level as varchar), row_number() over (order by level), 'year'
from (select distinct Year as level from pup_trials where Year is not null)""",
    "P22_sequence": ctes("juvenile") + """select round(lo + i * (hi - lo) / 499, 6) as x
from (select min(tagWT) as lo, max(tagWT) as hi from juvenile), range(500) r(i)""",
    "P23_logit": ctes("trials") + """select row_idx, round(1 / (1 + exp(-(walk / 100 - 1))), 6) as p,
  round(walk / 100 - 1, 6) as eta from trials""",
    "F1_conjunction": ctes("pup_trials") + """select row_idx from pup_trials
where Ageclass = 'J' and "Proceed with caution" = 'N' and Observer <> 'SWK'""",
    "F2_F5_predicates": ctes("cones") + """select Grid as grid, cast(Year as bigint) as year, count(*) as n from cones
where Grid in ('AG', 'CH', 'BT') and Year between 1997 and 1999 and NumNew is not null and NumNew > 10
group by Grid, Year""",
    "F6_region_rules": ctes(
        "dbamidden", "census",
        ("located", """select squirrel_id, locX as locx, locY as locy, grid, date from dbamidden
union all select squirrel_id, locx, locy, gr, census_date from census"""), *DENSITY[3:5]
    ) + """select grid, cast(year as bigint) as year, count(*) as records, cast(sum(x) as double) as sum_x
from inside where squirrel_id is not null group by grid, year""",
    "F7_repeat_trials": ctes("trials") + """select row_idx, observer, trialnumber from (
  select *, first_value(observer) over (partition by sq_id, year order by row_idx) as first_observer from trials)
where not (year in (2017, 2018) and first_observer = 'ARM') or trialnumber = 1""",
    "F8_complete_cases": ctes("pup_trials") + """select row_idx from pup_trials
where "Sq ID" is not null and Walk is not null and Hang is not null and Comments is not null""",
    "F4_missing_birth_dates": ctes(*TRIALS) + """select squirrel_id, cast(year as bigint) as year, litter_id, dam_id,
  cast(n1_date as bigint) as n1_date from cleaned where part is null""",
    "J1_W2_group_size": ctes("juvenile") + """select a.squirrel_id, a.litter_id, round(a.weight, 6) as weight,
  round(a.tagWT, 6) as tagwt, b.litter_size from juvenile a
join (select litter_id, count(squirrel_id) as litter_size from juvenile group by litter_id) b
  on a.litter_id = b.litter_id""",
    "J2_left_join": ctes("juvenile", "litter") + """select j.squirrel_id, j.litter_id, l.grid from juvenile j
left join (select * from litter where id % 3 = 0) l on j.litter_id = l.id""",
    "J3_left_join_present": ctes("juvenile", "pup_litter") + """select j.squirrel_id, j.litter_id,
  cast(l.date1 as varchar) as date1 from juvenile j left join pup_litter l on j.litter_id = l.id
where l.date1 is not null""",
    "J4_null_safe_join": ctes("pup_trials", "pup_juvenile") + """select t."Sq ID" as squirrel_id, t.row_idx, j.litter_id,
  round(j.weight, 6) as weight, round(j.tagWT, 6) as tagwt
from pup_trials t left join pup_juvenile j on t."Sq ID" is not distinct from j.squirrel_id""",
    "J5_three_key_join": ctes(*TRIALS, "pup_last_seen") + """select c.squirrel_id, c.litter_id, c.dam_id, c.row_idx,
  cast(c.n2_date as varchar) as datee_per, cast(f.datee as varchar) as datee_fla, cast(f.f2 as bigint) as f2
from cleaned c left join pup_last_seen f on c.squirrel_id is not distinct from f.squirrel_id
  and c.litter_id is not distinct from f.litter_id and c.dam_id is not distinct from f.dam_id""",
    "J6_renamed_keys": ctes("pup_last_seen", "pup_census", "pup_census_next", CENSI) + """select f.squirrel_id,
  cast(f.byear as bigint) as byear, cast(f.f1 as bigint) as f1, cast(s.made_it as bigint) as made_it
from pup_last_seen f left join censi s on f.squirrel_id is not distinct from s.squirrel_id
  and f.byear is not distinct from s.census_year""",
    "J7_dimension_join": ctes("pup_trials", *DENSITY) + """select t.row_idx, t.Grid as grid,
  cast(t.Year as bigint) as year, d.spr_density as grid_density
from pup_trials t left join density d on t.Grid is not distinct from d.grid and t.Year is not distinct from d.year""",
    "A1_A4_group_totals": ctes("cones") + """select Grid as grid, cast(sum(NumNew) as bigint) as total,
  round(avg(NumNew), 6) as mean, count(NumNew) as counted from cones group by Grid""",
    "A5_group_rates": ctes(*TRIALS) + """select cast(year as bigint) as year, sex, count(*) as n,
  cast(sum(case when part > 180 then 1 else 0 end) as bigint) as survival,
  round(sum(case when part > 180 then 1 else 0 end) / count(*)::double, 6) as survival_rate
from cleaned where part is not null and year not in (2001) group by year, sex""",
    "A6_medians": ctes("juvenile", "trials") + """select
  (select round(median(weight), 6) from juvenile) as weight, (select round(median(tagWT), 6) from juvenile) as tagwt,
  (select round(median(walk), 6) from trials) as walk, (select round(median(jump), 6) from trials) as jump""",
    "A3_A7_extremes": ctes("juvenile") + """select min(weight) as lo, max(weight) as hi, round(avg(weight), 6) as mean,
  count(distinct litter_id) as litters from juvenile""",
    "A8_M4_standardise": ctes("juvenile") + """select litter_id, squirrel_id,
  round((weight - (select avg(weight) from juvenile)) / (select stddev_samp(weight) from juvenile), 5) as weight_sc
from juvenile""",
    "W1_group_zscores": ctes("trials") + """select row_idx,
  round((walk - avg(walk) over w) / nullif(stddev_samp(walk) over w, 0), 6) as walk_sc,
  round((jump - avg(jump) over w) / nullif(stddev_samp(jump) over w, 0), 6) as jump_sc
from trials window w as (partition by observer, year)""",
    "W3_first_value": ctes("trials") + """select distinct sq_id, year,
  first_value(observer) over (partition by sq_id, year order by row_idx) as observer from trials""",
    "O1_order_desc": ctes("pup_juvenile") + """select squirrel_id, litter_id, round(weight, 6) as weight,
  round(tagWT, 6) as tagwt from pup_juvenile order by litter_id desc""",
    "O2_best_row": ctes("cones") + """select cast(Year as bigint) as year, round(avg(NumNew), 1) as metric from cones
where NumNew is not null group by Year order by 2, 1 desc limit 1""",
    "U1_union_distinct": ctes("dbamidden", "census") + """select reflo, squirrel_id, locX as locx, locY as locy, grid,
  cast(date as varchar) as date, Sex as sex from dbamidden
union
select reflo, squirrel_id, locx, locy, gr, cast(census_date as varchar), sex from census""",
    "U2_bind_rows": ctes("litter", "pup_census") + """select id as k, grid, cast(null as varchar) as census_date from litter
union all
select squirrel_id, null, cast(census_date as varchar) from pup_census""",
    "M5_M6_dummies": ctes(*LITTER_ROWS) + f"""select litter_id, grid, cast(year as bigint) as year, {dummies()}
from dated, (select list(grid order by k) as levels from (select grid, min(litter_id) as k from dated group by grid)) g,
  (select list(year order by year) as levels from (select distinct year from dated)) y""",
    "M1_split": ctes("litter") + f"""select id, grid,
  case when {draw("id || '|1'")} < {int(0.8 * STEPS)} then 'train' else 'test' end as part from litter""",
    "M2_bootstrap": ctes("litter") + f"""select rep, round(avg(w), 6) as mean_weight,
  round(avg((w = 0)::int::double), 6) as out_of_bag
from (select rep, {' + '.join(f'(u >= {x})::int' for x in poisson_limits(STEPS))} as w
  from (select r.rep, {draw("id || '|1|' || r.rep")} as u from litter, range(25) r(rep))) group by rep""",
    "M2_exact_bootstrap": ctes("trials") + """select rep, count(*) as n_rows, count(*) as n_draws, 1::bigint as valid
from trials, range(25) r(rep) group by rep""",
    "M7_lasso": ctes(*LITTER_ROWS) + """select penalty, round(my - slope * mx, 4) as intercept, round(slope, 4) as slope
from (select penalty, mx, my, sign(cxy) * greatest(abs(cxy / sx) - penalty, 0) / sx as slope
  from (select avg(n1_date) as mx, avg(part) as my, stddev_pop(n1_date) as sx, covar_pop(n1_date, part) as cxy from dated),
    (select unnest([0.1::double, 1.0, 10.0, 1000.0]) as penalty))""",
    "M11_holdout": ctes(*LITTER_ROWS) + """select round(sqrt(mse), 6) as rmse, round(1 - mse / v, 6) as r2 from (
  select avg(pow(part - (10.0 + 0.9 * n1_date + 0.05 * n1_weight), 2)) as mse, var_pop(part) as v from dated)""",
    "M12_scoring": ctes(*TRIALS, *LITTER_ROWS[2:]) + """select row_idx, squirrel_id,
  coalesce(n1_weight is not null and n1_date is not null and litter_size is not null
    and grid in (select grid from dated) and year in (select year from dated), false) as predicted from cleaned""",
    "M13_imputation": ctes(*TRIALS, *LITTER_ROWS[2:]) + """select row_idx, squirrel_id, cast(part as bigint) as part,
  coalesce(part is not null or (n1_weight is not null and n1_date is not null and litter_size is not null
    and grid in (select grid from dated) and year in (select year from dated)), false) as filled from cleaned""",
    "D1_median_fill": ctes("pup_trials") + "select row_idx, " + ", ".join(
        f"round(coalesce({c}, (select median({c}) from pup_trials)), 6) as {c.lower()}" for c in ("Walk", "Hang", "Attack")
    ) + " from pup_trials",
    "D2_component_pair": ctes("trials", ("filled", """select row_idx,
  coalesce(walk, (select median(walk) from trials)) as walk, jump from trials""")) + """select row_idx,
  round(((walk - (select avg(walk) from filled)) / (select stddev_samp(walk) from filled)
    + (select sign(corr(walk, jump)) from filled)
      * (jump - (select avg(jump) from filled)) / (select stddev_samp(jump) from filled)) / sqrt(2.0), 5) as score
from filled""",
    "D2_correlations": ctes("pup_trials") + "\nunion all\n".join(
        f"select '{a}' as first, '{b}' as second, round(corr({a}, {b}), 6) as r from pup_trials"
        for a, b in combinations(STAT_COLUMNS, 2)
    ),
    "G1_design": recursive(*SCORES) + "select row_idx, squirrel_id, " + ", ".join(
        f'round("{c}", 4) as {c.lower()}' for c in DESIGN) + " from design",
    "G2_G3_plain_logit": ctes("pup_trials") + """select term, round(estimate, 4) as estimate,
  round(std_error, 4) as std_error, round(estimate / std_error, 4) as z
from (select unnest(['male', 'constant']) as term, unnest([ln(d / c) - ln(b / a), ln(b / a)]) as estimate,
    unnest([sqrt(1 / a + 1 / b + 1 / c + 1 / d), sqrt(1 / a + 1 / b)]) as std_error
  from (select count(*) filter (male = 0 and y = 0)::double as a, count(*) filter (male = 0 and y = 1)::double as b,
      count(*) filter (male = 1 and y = 0)::double as c, count(*) filter (male = 1 and y = 1)::double as d
    from (select case when Sex = 'M' then 1 else 0 end as male, case when Walk > 20 then 1 else 0 end as y
      from pup_trials where Walk is not null and Sex is not null)))""",
    "G4_term_tests": recursive(*SCORES) + """select term, round(chi_square, 5) as chi_square, cast(1 as bigint) as df from (
  select unnest(['part', 'density', 'part:density']) as term,
    unnest([(0.16 * r - 2 * 0.4 * 0.2 * pr + 0.04 * p) / (p * r - pr * pr) - 0.04 / r,
            (0.09 * r + 2 * 0.3 * 0.2 * dr + 0.04 * d) / (d * r - dr * dr) - 0.04 / r, 0.04 / r]) as chi_square
  from (select var_samp(part_rel) as p, var_samp(density) as d, var_samp(part_x_density) as r,
    covar_samp(part_rel, part_x_density) as pr, covar_samp(density, part_x_density) as dr from design))""",
    "G2_crossed_fit": """select 'fixed' as factor, unnest(['constant', 'quantity']) as level, true as balanced
union all select distinct 'supplier', l_suppkey::varchar, true from lineitem
union all select distinct 'part', l_partkey::varchar, true from lineitem""",
    "G5_prediction_curve": recursive(*SCORES) + f"""select round(mis1, 5) as mis1, round(1 / (1 + exp(-({LINK}))), 5) as response
from (select *, part_rel * density as part_x_density, growth_rel * density as growth_x_density, oft1 * mis1 as oft1_x_mis1,
    oft1 * density as oft1_x_density, mis1 * density as mis1_x_density, oft1 * mis1 * density as oft1_x_mis1_x_density
  from (select lo - 1 + i * (hi - lo + 1) / 499 as mis1, oft1, 0.0::double as part_rel, growth_rel, 1.0::double as constant,
      0.0::double as "sexM", 0.0::double as age, -md / sd as density, 0.0::double as "gridAG", 0.0::double as "gridCH",
      1.0::double as "gridKL", 0.0::double as "gridLL"
    from (select min(mis1) as lo, max(mis1) as hi, avg(oft1) as oft1, median(growth) as growth_rel,
      avg(grid_density) as md, stddev_samp(grid_density) as sd from complete), range(500) r(i)))""",
    "G6_link_predictions": recursive(*SCORES) + f"""select row_idx, squirrel_id,
  round({LINK} + coalesce(avg(walk) over (partition by dam_id), 0), 4) as link from design""",
    "G7_uniformity": ctes("trials") + """select count(*) as n, round(greatest(max(i / n - u), max(u - (i - 1) / n)), 6) as ks
from (select walk / 500.0 as u, row_number() over (order by walk)::double as i, count(*) over ()::double as n
  from trials where walk is not null)""",
    "G7_residuals": recursive(*SCORES) + """select row_idx, squirrel_id, made_it = 1 as above, true as finite from design""",
    "G7_residual_values": ctes(*RESIDUALS) + "select l_orderkey, l_linenumber, round(u, 6) as residual from drawn",
    "G7_residual_trend": ctes(*RESIDUALS) + """select cast(bin as bigint) as bin, n, round(start, 5) as start, probability,
  round(quantile, 5) as quantile, round(share_below, 5) as share_below, round(z, 5) as z from trend""",
    "G7_residual_tests": ctes(*RESIDUALS) + """select 'uniformity' as test, round(greatest(max(i / n - u), max(u - (i - 1) / n)), 5)
  as statistic, 0.0::double as expected from (select u, row_number() over (order by u)::double as i,
  count(*) over ()::double as n from drawn)
union all select 'dispersion', round(sum(pow(y - mu, 2)) / sum(mu * (1 - mu)), 5), 1.0 from drawn
union all select 'outliers', round(avg((u < 1.0::double / 251 or u > 1 - 1.0::double / 251)::int::double), 5),
  round(2.0::double / 251, 5) from drawn
union all select 'trend_' || probability, round(sum(z * z), 5), count(*)::double from trend group by probability""",
    "Q9_behaviour_scores": recursive(*SCORES) + """select row_idx, squirrel_id, round(growth_sc, 5) as growth_sc,
  round(part_sc, 5) as part_sc, round(oft1, 5) as oft1, round(mis1, 5) as mis1, cast(survival as bigint) as survival
from scored""",
    "T1_survival_rates": recursive(*SCORES) + """select cast(year as bigint) as year, sex, count(*) as n,
  cast(sum(made_it) as bigint) as survival, round(sum(made_it) / count(*)::double, 6) as survival_rate
from complete where year <> 2001 group by year, sex""",
    "T2_score_ellipse": recursive(*SCORES) + """select round(x, 4) as centre_x, round(y, 4) as centre_y,
  round(sqrt(((xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy)) * r2), 4) as long_axis,
  round(sqrt(((xx + yy) / 2 - sqrt(pow((xx - yy) / 2, 2) + xy * xy)) * r2), 4) as short_axis,
  round(0.5 * atan2(2 * xy, xx - yy), 4) as angle
from (select avg(oft1) as x, avg(mis1) as y, var_samp(oft1) as xx, var_samp(mis1) as yy, covar_samp(oft1, mis1) as xy,
  (count(*) - 1) * (pow(0.05::double, -2.0 / (count(*) - 1)) - 1) as r2 from scored)""",
    "T3_observed_outcomes": recursive(*SCORES) + """select round(mis1, 5) as mis1, cast(made_it as double) as response,
  'observed' as source from design""",
    "T4_density_links": recursive(*SCORES) + f"""select grid_density, round(mis1, 4) as mis1,
  cast(made_it as bigint) as made_it,
  round({LINK} + coalesce(avg(walk) over (partition by dam_id), 0), 4) as link from design""",
}
SQL |= {f"{name}_from_csv": SQL[name] for name in ("F7_repeat_trials", "W3_first_value")}
