"""Study tables derived from the driver's parquet tables.

Each text is a SELECT both Spark SQL and the checking engine understand; `text` is the name of the string type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GRID_OF_ORDER = """case o_orderpriority when '1-URGENT' then 'KL' when '2-HIGH' then 'SU' when '3-MEDIUM' then 'CH'
    when '5-LOW' then 'AG' else 'LL' end"""

CENSUS = """select l_suppkey as squirrel_id,
  concat(chr(cast(64 + l_partkey % 24 + 1 as int)), '.', cast(l_linenumber as {text})) as locx,
  cast(l_quantity / 2 as {text}) as locy,
  case l_partkey % 5 when 0 then 'KL' when 1 then 'SU' when 2 then 'CH' when 3 then 'LL' else 'AG' end as gr,
  cast(l_shipdate as date) as census_date, 'reflo' as reflo,
  case l_suppkey % 2 when 0 then 'F' else 'M' end as sex, l_tax
from lineitem"""

TABLES = {
    "litter": ("orders", f"""select o_orderkey as id, {GRID_OF_ORDER} as grid, cast(o_orderdate as date) as date1,
  case when o_orderkey % 7 = 0 then null else cast(o_orderdate as date) - cast(o_orderkey % 25 as int) end
    as fieldBDate,
  cast(o_orderdate as date) + 25 as tagDt, o_custkey as squirrel_id
from orders"""),
    "juvenile": ("lineitem", """select l_partkey as squirrel_id, l_orderkey as litter_id,
  case when l_linenumber = 7 then null else l_quantity end as weight, l_extendedprice / 1000 as tagWT
from lineitem"""),
    "census": ("lineitem", f"select squirrel_id, reflo, locx, locy, gr, census_date, sex from ({CENSUS}) c"),
    "dbamidden": ("lineitem", f"""select reflo, squirrel_id, locx as locX, locy as locY, gr as grid,
  census_date as date, sex as Sex from ({CENSUS}) c where l_tax > 0.04"""),
    "cones": ("lineitem", """select case l_partkey % 7 when 0 then 'AG' when 1 then 'CH' when 2 then 'JO'
    when 3 then 'KL' when 4 then 'LL' when 5 then 'SU' else 'ZZ' end as Grid,
  year(l_shipdate) as Year, case when l_linenumber = 7 then null else cast(l_quantity as bigint) end as NumNew
from lineitem"""),
    "trials": ("events", """select user_id as sq_id, 2017 + event_id % 5 as year,
  case event_type when 'error' then 'ARM' when 'signup' then 'SWK' else 'OTH' end as observer,
  1 + event_id % 3 as trialnumber, event_id as row_idx,
  concat(cast(month(ts) as {text}), '/', cast(day(ts) as {text}), '/',
         case when event_id % 10 = 0 then '70' else '17' end) as trialdate,
  case when event_id % 11 = 0 then null else value end as walk,
  cast(event_id % 13 as double) + value as jump
from events"""),
    # The tables below describe one cohort study: every order is a juvenile, every third order also a litter.
    "pup_litter": ("orders", f"""select o_orderkey as id, {GRID_OF_ORDER} as grid, cast(o_orderdate as date) as date1,
  case when o_orderkey % 7 = 0 then null else cast(o_orderdate as date) - cast(o_orderkey % 25 as int) end
    as fieldBDate,
  cast(o_orderdate as date) + 25 as tagDt, o_custkey as squirrel_id
from orders where o_orderkey % 3 = 0"""),
    "pup_juvenile": ("orders", """select case when o_orderkey = 503 then null else o_orderkey end as squirrel_id,
  o_orderkey - o_orderkey % 3 as litter_id,
  case when o_orderkey % 41 = 0 then null
       else 20 + o_totalprice / 70000 + cast(o_orderkey % 25 as double) * 0.8 end as weight,
  60 + o_totalprice / 30000 + cast(o_orderkey % 17 as double) as tagWT
from orders"""),
    "pup_census": ("orders", f"""select o_orderkey as squirrel_id, {GRID_OF_ORDER} as gr,
  make_date(cast(year(o_orderdate) as int), case when o_orderkey % 2 = 0 then 8 else 5 end, 15) as census_date
from orders where (o_orderkey * 7) % 10 + (o_custkey * 13) % 10 > 6"""),
    "pup_census_next": ("orders", f"""select o_orderkey as squirrel_id, {GRID_OF_ORDER} as gr,
  make_date(cast(case when o_orderkey % 4 = 0 then 2001 else 2002 end as int), 6, 1) as census_date
from orders where o_orderkey % 5 < 3"""),
    "last_seen": ("orders", """select o_custkey as squirrel_id, o_orderkey as litter_id, o_custkey % 50 as dam_id,
  year(o_orderdate) as byear,
  case when o_orderkey % 11 = 0 then null else cast(o_orderdate as date) + cast(o_orderkey % 400 as int) end as datee,
  cast(o_orderdate as date) as fieldBDate
from orders"""),
    "pup_last_seen": ("orders", """select j.o_orderkey as squirrel_id, j.o_orderkey - j.o_orderkey % 3 as litter_id,
  l.o_custkey as dam_id, cast(j.o_orderdate as date) as dates, cast(j.o_orderkey % 4 as int) as f1,
  cast(year(l.o_orderdate) as int) as byear,
  case when j.o_orderkey % 11 = 0 then null
       else cast(l.o_orderdate as date) + cast((j.o_orderkey * 31) % 400 as int) end as datee,
  cast(j.o_orderkey % 5 as int) as f2
from orders j join orders l on l.o_orderkey = j.o_orderkey - j.o_orderkey % 3"""),
    "pup_trials": ("events", """select
  case when event_id % 101 = 0 then null when event_id % 37 = 0 then event_id + 10000000
       else event_id - event_id % 2 end as `Sq ID`,
  case when (event_id - event_id % 2) % 10 < 5 then 'F' else 'M' end as `Sex`,
  cast(1996 + ((event_id - event_id % 2) % 12) / 2 as int) as `Year`,
  case event_type when 'error' then 'ARM' when 'signup' then 'SWK' else 'OTH' end as `Observer`,
  'wild' as `Cohort`,
  case (event_id - event_id % 2) % 7 when 0 then 'KL' when 1 then 'SU' when 2 then 'CH' when 3 then 'JO'
       when 4 then 'LL' when 5 then 'AG' else 'KL' end as `Grid`,
  cast(1 + event_id % 3 as int) as `Trialnumber`,
  concat(cast(1 + event_id % 12 as {text}), '/', cast(1 + (event_id * 7) % 28 as {text}), '/',
         case (event_id - event_id % 2) % 12 when 0 then '96' when 2 then '97' when 4 then '98' when 6 then '99'
              when 8 then '00' else '01' end) as `Trialdate`,
  concat('L', cast(event_id % 999 as {text})) as `Taglft`, concat('R', cast(event_id % 997 as {text})) as `Tagrt`,
  case when event_id % 19 = 0 then null else 'B/W' end as `Colours`,
  case when event_id % 11 = 0 then null else value end as `Walk`,
  cast(event_id % 13 as double) + value as `Jump`,
  cast(event_id % 7 as double) as `Hole`,
  case when event_id % 23 = 0 then null else cast(event_id % 29 as double) + value / 3 end as `Hang`,
  cast(event_id % 5 as double) + value / 10 as `Chew`,
  cast(event_id % 3 as double) as `Groom`,
  450 - value + cast(event_id % 31 as double) as `Still`,
  450.0E0 as `OFT duration`,
  cast(event_id % 17 as double) + value / 5 as `Front`,
  cast((event_id * 3) % 19 as double) as `Back`,
  case when event_id % 31 = 0 then null else cast((event_id * 5) % 11 as double) + value / 20 end as `Attack`,
  cast(300 - (event_id * 5) % 11 as double) - value / 4 as `Attacklatency`,
  cast((event_id * 11) % 300 as double) as `Approachlatency`,
  300.0E0 as `MIS duration`,
  'N' as `Collar`,
  case when event_id % 43 = 0 then 'wet, cold' else null end as `Comments`,
  case when event_id % 53 = 0 then 'A' else 'J' end as `Ageclass`,
  case when event_id % 47 = 0 then 'Y' else 'N' end as `Exclude (unless video reanalyzed)`,
  case when event_id % 59 = 0 then null else 'N' end as `Proceed with caution`,
  event_id as `row_idx`
from events"""),
}


def standin_sql(name: str, text: str = "varchar") -> str:
    """The SELECT behind a study table in the checking engine's dialect."""
    return TABLES[name][1].format(text=text).replace("`", '"')


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A study table over the parquet files in `sf_dir`."""
    base, select = TABLES[name]
    source = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    select = select.format(text="string").replace(f"from {base}", f"from {{{base}}}").replace(
        f"join {base}", f"join {{{base}}}"
    )
    return spark.sql(select, **{base: source})
