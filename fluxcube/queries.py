"""Registered queries: one for each operator on cubes, over the relational tables, with the same in SQL for DuckDB."""

from __future__ import annotations

import datetime
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxcube.cube import Cube
from fluxcube.functions.codes import entity_name, ipcc_code, map_distinct, parse_code_column, unit_name
from fluxcube.meta import VariableMeta
from fluxcube.operators import aggregate, align, arithmetic, convert, downscale, gaps, gwp, select, validate
from fluxcube.operators.select import Not
from fluxcube.plans import compose, strategies
from fluxcube.plans.definitions import PriorityDefinition, StrategyDefinition
from fluxcube.sources import interchange, inventory, store, tables
from fluxcube.sources.views import EVENTS_SQL, LINEITEM_SQL, ORDERS_SQL, events_cube, lineitem_cube, orders_cube, table
from fluxcube.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def cells(cube: Cube, digits: int | None = None) -> DataFrame:
    value = F.col("value") if digits is None else F.round("value", digits)
    return cube.df.where("value is not null").select(*cube.keys, value.alias("value"))


def _day(year: int, month: int = 1) -> datetime.date:
    return datetime.date(year, month, 1)


# --- selection --------------------------------------------------------------------------------------------------------


@query(f"with {ORDERS_SQL} select area, source, time, variable, value from cube where area in ('NATION_1', 'NATION_2') and category = 'BUILDING'")
def loc_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(select.loc(orders_cube(spark, sf_dir), {"area (NATION)": ["NATION_1", "NATION_2"], "cat": "BUILDING"}))


@query(f"with {ORDERS_SQL} select * from cube where time between '1996-01-01' and '1998-12-31'")
def loc_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(select.loc(orders_cube(spark, sf_dir), {"time": slice("1996", "1998")}))


@query(f"with {ORDERS_SQL} select * from cube where category <> 'BUILDING' and source not in ('1-URGENT', '5-LOW') and time between '1997-05-01' and '1997-05-31'")
def loc_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(select.loc(orders_cube(spark, sf_dir), {"category": Not("BUILDING"), "source": Not(["1-URGENT", "5-LOW"]), "time": "1997-05"}))


@query(f"""with {ORDERS_SQL}, s as (select distinct source, time, variable from cube), g as (select * from s, (select distinct area from cube), (select distinct category from cube))
select area, category, source, time, variable, case when category = 'BUILDING' and area = 'NATION_1' then 0.5 else value end as value from g left join cube using (area, category, source, time, variable)
where value is not null or (category = 'BUILDING' and area = 'NATION_1')""")
def assign_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(select.assign(orders_cube(spark, sf_dir), {"category": "BUILDING", "area": "NATION_1"}, 0.5))


@query(f"with {LINEITEM_SQL} select area, source, 'HIGH' as scenario, time, variable, value from cube")
def expand_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(select.expand_dims(lineitem_cube(spark, sf_dir), "scenario", "HIGH", "SCEN"))


@query("select distinct c_mktsegment as category from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def get_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.get(orders_cube(spark, sf_dir), "cat")


@query("""select o_orderkey from orders where ((o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH')) or o_orderpriority = '5-LOW') and not (o_orderstatus = 'O' and o_orderpriority = '5-LOW')""")
def filter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = {"a": {"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"]}, "b": {"o_orderpriority": "5-LOW"}}
    return select.filter_rows(table(spark, sf_dir, "orders"), keep, {"c": {"o_orderstatus": "O", "o_orderpriority": "5-LOW"}}).select("o_orderkey")


# --- aggregation ------------------------------------------------------------------------------------------------------


@query(f"with {ORDERS_SQL} select area, time, variable, coalesce(sum(value), 0) as value from cube group by all")
def sum_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(aggregate.sum_cells(orders_cube(spark, sf_dir), reduce_to_dim=["area", "time"]))


@query(f"with {ORDERS_SQL} select area, source, time, variable, case when count(value) >= 3 then sum(value) end as value from cube group by all having count(value) >= 3")
def sum_skipna_mincount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(aggregate.sum_cells(orders_cube(spark, sf_dir), "category", skipna=True, min_count=3))


@query(f"with {ORDERS_SQL} select area, source, time, variable, sum(value) as value from cube group by all having count(value) = (select count(distinct category) from cube)")
def sum_skipna_false(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(aggregate.sum_cells(orders_cube(spark, sf_dir), "category", skipna=False))


_DENSE_EVENTS = """g as (select a.area, c.category, t.time, 'CO2' as variable from (select distinct area from cube) a, (select distinct category from cube) c, (select distinct time from cube) t),
d as (select g.*, value, count(value) over (partition by g.area, g.category) as n from g left join cube using (area, category, time, variable)),
f as (select area, category, time, variable, case when n = 0 then 0.0 else value end as value from d)"""


@query(f"with {EVENTS_SQL}, {_DENSE_EVENTS} select area, time, variable, sum(value) as value from f group by all having count(value) = (select count(distinct category) from cube)")
def sum_skipna_evaldims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(aggregate.sum_cells(events_cube(spark, sf_dir), "category", skipna_evaluation_dims="time"))


@query(f"with {LINEITEM_SQL} select area, source, time, 'total' as variable, coalesce(sum(case variable when 'CO2' then value when 'CH4' then value * 25.0::double else value * 22800.0::double end), 0) as value from cube group by all")
def sum_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = lineitem_cube(spark, sf_dir)
    for gas in ("CO2", "CH4", "SF6"):
        cube = gwp.convert_to_gwp(cube, gas, "AR4GWP100")
    return cells(aggregate.sum_cells(cube, "entity"))


@query(f"with {ORDERS_SQL} select category, time, variable, count(value) as value from cube group by all")
def count_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.count(orders_cube(spark, sf_dir), reduce_to_dim=["category", "time"])


@query(f"with {LINEITEM_SQL} select area, variable, bool_or(value <> 0) as value from cube group by all")
def any_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.any_cell(lineitem_cube(spark, sf_dir), ["source", "time"])


@query(f"with {EVENTS_SQL}, {_DENSE_EVENTS} select area, category, time, variable, value from f where value is not null")
def fill_all_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(aggregate.fill_all_na(events_cube(spark, sf_dir), "time"))


@query(f"""with {EVENTS_SQL} select area, category, count(value) as coverage from (select distinct area from cube) a cross join (select distinct category from cube) c left join cube using (area, category) group by all""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.coverage(events_cube(spark, sf_dir), "area", "category")


@query(f"""with {LINEITEM_SQL} select variable, source, time, count(value) as coverage from (select distinct variable from cube) v cross join (select distinct source from cube) s cross join (select distinct time from cube) t
left join cube using (variable, source, time) group by all""")
def coverage_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.coverage(lineitem_cube(spark, sf_dir), "entity", "source", "time")


@query(f"""with {ORDERS_SQL}, ab as (select area, 'GOODS' as category, source, time, variable, sum(value) as value from cube where category in ('FURNITURE', 'MACHINERY') group by all),
late as (select area, 'ALL' as category, source, time, variable, sum(value) as value from (select * from cube where category in ('BUILDING', 'HOUSEHOLD') union all select * from ab) where time >= '1998-01-01' group by all)
select * from cube union all select * from ab union all select * from late""")
def add_aggregates_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [aggregate.Rule("GOODS", ["FURNITURE", "MACHINERY"]), aggregate.Rule("ALL", ["BUILDING", "HOUSEHOLD", "GOODS"], sel={"time": slice("1998", None)})]
    return cells(aggregate.add_aggregates_coordinates(orders_cube(spark, sf_dir), {"category": rules}))


# --- alignment --------------------------------------------------------------------------------------------------------


def _halves(spark: SparkSession, sf_dir: str) -> tuple[Cube, Cube]:
    """The lines shipped until 1998, and all areas' but three from 1997 on, a little larger."""
    cube = lineitem_cube(spark, sf_dir)
    first = cube.with_df(cube.df.where(F.col("time") <= F.lit(_day(1998))))
    second = cube.with_df(cube.df.where((F.col("time") >= F.lit(_day(1997))) & ~F.col("area").isin("NATION_1", "NATION_2", "NATION_3")).withColumn("value", F.col("value") + 1))
    return first, second


_HALVES = f"""{LINEITEM_SQL}, a as (select * from cube where time <= '1998-01-01'),
b as (select area, source, time, variable, value + 1 as value from cube where time >= '1997-01-01' and area not in ('NATION_1', 'NATION_2', 'NATION_3'))"""


@query(f"""with {_HALVES} select area, source, time, variable, coalesce(a.value, b.value) as value from a full join (select * from b
where area in (select area from a) and source in (select source from a) and time in (select time from a)) b using (area, source, time, variable)""")
def fillna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(align.fillna(*_halves(spark, sf_dir)))


@query(f"with {_HALVES} select area, source, time, variable, coalesce(a.value, b.value) as value from a full join b using (area, source, time, variable)")
def combine_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(align.combine_first(*_halves(spark, sf_dir)))


@query(f"with {_HALVES} select area, source, time, variable, coalesce(a.value, b.value) as value from a full join b using (area, source, time, variable)")
def merge_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(align.merge(*_halves(spark, sf_dir), tolerance=10.0))


@query(f"with {_HALVES} select area, source, time, variable, a.value as va, b.value as vb, abs(a.value - b.value) / a.value as deviation from a join b using (area, source, time, variable) where abs(a.value - b.value) / a.value > 0.005")
def merge_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.deviations(*_halves(spark, sf_dir), tolerance=0.005)


@query(f"""with {LINEITEM_SQL} select * from cube where time <> '1997-01-01' union all
select area, source, date '1997-01-01', variable, 7.0 from (select distinct area, source, variable from cube)""")
def set_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(align.set_values(lineitem_cube(spark, sf_dir), "time", "1997", 7.0, existing="overwrite"))


@query(f"""with {LINEITEM_SQL} select * from cube union all
select area, source, t, variable, 3.5 from (select distinct area, source, variable from cube), (select unnest([date '1997-01-01', date '2010-01-01']) as t)
where (area, source, t, variable) not in (select area, source, time, variable from cube)""")
def set_fillna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(align.set_values(lineitem_cube(spark, sf_dir), "time", ["1997", "2010"], 3.5, existing="fillna"))


@query(f"""with {LINEITEM_SQL} select a.area, a.source, a.time, 'share' as variable, a.value / t.value as value from (select * from cube where variable = 'CO2') a
join (select area, time, sum(value) as value from cube where variable = 'CO2' group by all) t using (area, time)""")
def arithmetic_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = lineitem_cube(spark, sf_dir).variable("CO2")
    return cells(arithmetic.combine(cube, aggregate.sum_cells(cube, "source"), "/", "share"))


@query(f"""with {LINEITEM_SQL} select a.area, a.source, a.time, 'both' as variable, a.value + b.value * 25.0::double as value from (select * from cube where variable = 'CO2') a
join (select * from cube where variable = 'CH4') b using (area, source, time)""")
def arithmetic_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = gwp.convert_to_gwp(lineitem_cube(spark, sf_dir), "CH4", "AR4GWP100")
    return cells(arithmetic.combine(cube.variable("CO2"), cube.variable("CH4 (AR4GWP100)"), "+", "both"))


@query(f"""with {LINEITEM_SQL} select area, source, time, max(value) filter (variable = 'CO2') as "CO2", max(value) filter (variable = 'CH4') as "CH4", max(value) filter (variable = 'SF6') as "SF6" from cube group by all""")
def frame_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arithmetic.to_frame(lineitem_cube(spark, sf_dir), "entity", ["CO2", "CH4", "SF6"])


@query(f"""with {LINEITEM_SQL}, a as (select area, source, time, value from cube where variable = 'CO2'), b as (select area, source, time, value from cube where variable = 'CH4' and time >= '1997-01-01')
select area, source, time, 'left' as variable, a.value - b.value as value from a left join b using (area, source, time)""")
def arithmetic_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = lineitem_cube(spark, sf_dir)
    late = cube.with_df(cube.df.where(F.col("time") >= F.lit(_day(1997))))
    ch4 = gwp.convert_to_gwp(late, "CH4", "AR4GWP100").variable("CH4 (AR4GWP100)")
    same = ch4.with_df(ch4.df.withColumn("value", F.col("value") / 25))  # as many Gg CO2 as it was Gg CH4
    return arithmetic.combine(cube.variable("CO2"), same, "-", "left", join="left").df.select(*cube.keys, "value")


@query(f"with {LINEITEM_SQL} select area, source, time, 'twice' as variable, 2 * value + 1 as value from cube where variable = 'CO2'")
def arithmetic_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = lineitem_cube(spark, sf_dir).variable("CO2")
    return cells(arithmetic.combine(cube, cube.with_df(cube.df.withColumn("value", F.col("value") + 1)), "+", "twice", join="exact"))


@query(f"""with {LINEITEM_SQL} select area, source, time, variable, value from cube where variable <> 'SF6'
union all select area, source, time, variable, value * 1.004::double from cube where variable = 'SF6'""")
def merge_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cube has CO2 and CH4, the other CH4, a little larger, and SF6."""
    cube = lineitem_cube(spark, sf_dir)
    only = lambda names: {k: v for k, v in cube.meta.variables.items() if k in names}
    first = cube.with_df(cube.df.where("variable <> 'SF6'"), cube.meta.with_(variables=only(("CO2", "CH4"))))
    second = cube.with_df(cube.df.where("variable <> 'CO2'").withColumn("value", F.col("value") * 1.004), cube.meta.with_(variables=only(("CH4", "SF6"))))
    return cells(align.merge(first, second, tolerance=0.005))


# --- units and baskets ------------------------------------------------------------------------------------------------


@query(f"with {LINEITEM_SQL} select area, source, time, variable, case when variable = 'CH4' then value * 1000.0::double else value end as value from cube")
def convert_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(gwp.convert_unit(lineitem_cube(spark, sf_dir), "CH4", "t CH4 / year"))


@query(f"with {LINEITEM_SQL} select area, source, time, case variable when 'CH4' then 'CH4 (AR6GWP100)' else variable end as variable, round(case when variable = 'CH4' then value * 27.9::double else value end, 6) as value from cube")
def gwp_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(gwp.convert_to_gwp(lineitem_cube(spark, sf_dir), "CH4", "AR6GWP100"), 6)


@query(f"with {LINEITEM_SQL} select area, source, time, variable, round(case when variable = 'SF6' then value * 1000 / 22800.0::double else value end, 9) as value from cube")
def mass_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = lineitem_cube(spark, sf_dir)
    variables = {k: v for k, v in cube.meta.variables.items() if k != "SF6"} | {"SF6 (AR4GWP100)": VariableMeta("SF6", "Mt CO2 / yr", "AR4GWP100")}
    given = cube.df.withColumn("variable", F.when(F.col("variable") == "SF6", "SF6 (AR4GWP100)").otherwise(F.col("variable")))
    mass = gwp.convert_to_mass(cube.with_df(given, cube.meta.with_(variables=variables)), "SF6 (AR4GWP100)")
    return cells(gwp.convert_unit(mass, "SF6", "Gg SF6 / yr"), 9)


@query(f"with {LINEITEM_SQL} select area, source, time, case variable when 'CH4' then 'CH4 (SARGWP100)' else variable end as variable, round(case when variable = 'CH4' then value * 21.0::double / 1000 else value end, 9) as value from cube")
def gwp_convert_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    like = VariableMeta("SF6", "Mt CO2 / yr", "SARGWP100")
    return cells(gwp.convert_to_gwp_like(lineitem_cube(spark, sf_dir), "CH4", like), 9)


_AR4 = "case variable when 'CO2' then value when 'CH4' then value * 25.0::double else value * 22800.0::double end"
GASES = ["CO2", "CH4", "SF6"]
BASKET = "KYOTOGHG (AR4GWP100)"


@query(f"with {LINEITEM_SQL} select area, source, time, '{BASKET}' as variable, sum({_AR4}) as value from cube group by all having count(value) = 3")
def gas_basket_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(gwp.gas_basket_contents_sum(lineitem_cube(spark, sf_dir), BASKET, GASES, skipna=False))


def _with_basket(spark: SparkSession, sf_dir: str, keep: F.Column) -> Cube:
    """The gases, and their basket where `keep` holds."""
    cube = lineitem_cube(spark, sf_dir)
    total = gwp.gas_basket_contents_sum(cube, BASKET, GASES, skipna=True)
    meta = cube.meta.with_(variables={**cube.meta.variables, BASKET: VariableMeta("KYOTOGHG", "Gg CO2 / yr", "AR4GWP100")})
    return cube.with_df(cube.df.unionByName(total.df.where(keep)), meta)


@query(f"with {LINEITEM_SQL} select * from cube union all select area, source, time, '{BASKET}', sum({_AR4}) from cube group by all")
def fill_basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(gwp.fill_na_gas_basket_from_contents(_with_basket(spark, sf_dir, F.year("time") < 1998), BASKET, GASES, skipna=True))


@query(f"""with {LINEITEM_SQL} select * from cube union all select area, source, time, '{BASKET}', sum({_AR4}) from cube group by all
union all select area, source, time, 'FGASES (AR4GWP100)', value * 22800.0::double from cube where variable = 'SF6'""")
def add_aggregates_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    baskets = [gwp.Basket("FGASES (AR4GWP100)", ["SF6", "NF3"]), gwp.Basket(BASKET, ["CO2", "CH4", "FGASES (AR4GWP100)"])]
    return cells(gwp.add_aggregates_variables(lineitem_cube(spark, sf_dir), baskets))


# --- downscaling ------------------------------------------------------------------------------------------------------


def _with_total(spark: SparkSession, sf_dir: str) -> Cube:
    """Categories in January and July only, and their total in every month."""
    cube = orders_cube(spark, sf_dir)
    total = aggregate.sum_cells(cube, "category").df.withColumn("category", F.lit("TOTAL"))
    return cube.with_df(cube.df.where(F.month("time").isin(1, 7)).unionByName(total.select(*cube.df.columns)))


_WITH_TOTAL = f"""{ORDERS_SQL}, parts as (select * from cube where month(time) in (1, 7)),
totals as (select area, source, time, variable, sum(value) as total from cube group by all),
sums as (select area, source, time, variable, sum(value) as s from parts group by all)"""
_PARTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"""with {_WITH_TOTAL},
q as (
  select t.area, c.category, t.source, t.time, t.variable, t.total, p.value, case when s.s <> 0 then p.value / s.s end as share, cast(date_diff('day', date '1970-01-01', t.time) as double) as x
  from totals t cross join (select unnest({_PARTS}) as category) c left join parts p using (area, category, source, time, variable) left join sums s using (area, source, time, variable)
), w as (
  select *, last_value(case when share is not null then x end ignore nulls) over a as x0, last_value(share ignore nulls) over a as q0,
    first_value(case when share is not null then x end ignore nulls) over b as x1, first_value(share ignore nulls) over b as q1
  from q window a as (partition by area, category, source, variable order by time rows between unbounded preceding and current row),
    b as (partition by area, category, source, variable order by time rows between current row and unbounded following)
), f as (
  select area, category, source, time, variable, coalesce(value, total * coalesce(share, case when x0 is null then q1 when x1 is null then q0 else q0 + (q1 - q0) * (x - x0) / (x1 - x0) end)) as value from w
)
select area, category, source, time, variable, round(value, 3) as value from f where value is not null
union all select area, 'TOTAL', source, time, variable, round(total, 3) from totals""")
def downscale_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(downscale.downscale_timeseries(_with_total(spark, sf_dir), "cat", "TOTAL", _PARTS), 3)


@query(f"""with {LINEITEM_SQL}, known as (select *, {_AR4} as v from cube where year(time) in (1996, 1999)),
totals as (select area, source, time, sum({_AR4}) as total from cube group by all), sums as (select area, source, time, sum(v) as s from known group by all),
q as (
  select t.area, t.source, t.time, g.variable, t.total, k.v, case when s.s <> 0 then k.v / s.s end as share, cast(date_diff('day', date '1970-01-01', t.time) as double) as x
  from totals t cross join (select unnest(['CO2', 'CH4', 'SF6']) as variable) g left join known k using (area, source, time, variable) left join sums s using (area, source, time)
), w as (
  select *, last_value(case when share is not null then x end ignore nulls) over a as x0, last_value(share ignore nulls) over a as q0,
    first_value(case when share is not null then x end ignore nulls) over b as x1, first_value(share ignore nulls) over b as q1
  from q window a as (partition by area, source, variable order by time rows between unbounded preceding and current row), b as (partition by area, source, variable order by time rows between current row and unbounded following)
), f as (
  select area, source, time, variable, coalesce(v, total * coalesce(share, case when x0 is null then q1 when x1 is null then q0 else q0 + (q1 - q0) * (x - x0) / (x1 - x0) end)) as v from w
)
select area, source, time, variable, round(v / case variable when 'CO2' then 1.0::double when 'CH4' then 25.0::double else 22800.0::double end, 6) as value from f where v is not null
union all select area, source, time, '{BASKET}', round(total, 6) from totals""")
def downscale_gas(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = _with_basket(spark, sf_dir, F.lit(True))
    known = cube.with_df(cube.df.where((F.col("variable") == BASKET) | F.year("time").isin(1996, 1999)))
    return cells(downscale.downscale_gas_timeseries(known, BASKET, GASES), 6)


@query(f"""with {_WITH_TOTAL}, j as (select area, category, source, variable, sum(value) as weight from cube group by all),
s as (select area, category, source, variable, weight / sum(weight) over (partition by area, source, variable) as share from j)
select t.area, s.category, t.source, t.time, t.variable, round(t.total * s.share, 3) as value from totals t join s using (area, source, variable)
union all select area, 'TOTAL', source, time, variable, round(total, 3) from totals""")
def downscale_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = _with_total(spark, sf_dir)
    weights = aggregate.sum_cells(orders_cube(spark, sf_dir), "time").df
    totals = cube.with_df(cube.df.where("category = 'TOTAL'"))
    return cells(downscale.downscale_timeseries_by_shares(totals, "category", "TOTAL", _PARTS, weights), 3)


# --- conversion -------------------------------------------------------------------------------------------------------

_RULES = convert.Conversion(
    "SEGMENT",
    "SECTOR",
    (
        convert.ConversionRule({"AUTOMOBILE": 1, "MACHINERY": 1}, {"1": 1}),
        convert.ConversionRule({"BUILDING": 1}, {"2": 2}),
        convert.ConversionRule({"BUILDING": 1, "HOUSEHOLD": -1}, {"3": 1}, {"PRIORITY": ("1-URGENT", "2-HIGH")}),
        convert.ConversionRule({"HOUSEHOLD": 1}, {"3": 1}, {"PRIORITY": ("2-HIGH", "3-MEDIUM")}),
        convert.ConversionRule({"FURNITURE": 1}, {"4": 1, "5": 2}),
        convert.ConversionRule({"MACHINERY": 1}, {"6": 1, "7": -1}),
        convert.ConversionRule({"AUTOMOBILE": 1}, {"7": 1, "8": 1, "9": 1}, {"PRIORITY": ("5-LOW",)}),
        convert.ConversionRule({"BUILDING": 1}, {"8": 1}),
    ),
)


@query(f"""with {ORDERS_SQL} select area, '1' as category, source, time, variable, sum(value) as value from cube where category in ('AUTOMOBILE', 'MACHINERY') group by all
union all select area, '2', source, time, variable, value / 2 from cube where category = 'BUILDING'
union all select area, '3', source, time, variable, sum(case category when 'BUILDING' then value else -value end) from cube where category in ('BUILDING', 'HOUSEHOLD') and source = '1-URGENT' group by all
union all select area, '3', source, time, variable, value from cube where category = 'HOUSEHOLD' and source in ('2-HIGH', '3-MEDIUM')
union all select area, 'A_(4+2*5)', source, time, variable, value + value / 2 from cube where category = 'FURNITURE'
union all select area, 'A_(7+8+9)', source, time, variable, value + value + value from cube where category = 'AUTOMOBILE' and source = '5-LOW'""")
def convert_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(convert.convert(orders_cube(spark, sf_dir), "category", _RULES, {"PRIORITY": "source"}))


# --- composition ------------------------------------------------------------------------------------------------------

_FO = PriorityDefinition(["source"], [{"source": "F"}, {"source": "O"}])
_URGENT = PriorityDefinition(["source"], [{"source": "1-URGENT"}, {"source": "2-HIGH"}])


@query(f"with {LINEITEM_SQL} select area, time, variable, arg_min(value, source) as value from cube where source in ('F', 'O') group by all")
def compose_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(compose.compose_substitution(lineitem_cube(spark, sf_dir), _FO))


_LS = f"""{ORDERS_SQL}, a as (select * from cube where source = '1-URGENT'), b as (select * from cube where source = '2-HIGH'),
j as (select area, category, time, variable, a.value as y, b.value as x from a full join b using (area, category, time, variable)),
n as (select area, category, variable, count(*) filter (x is not null and y is not null) as n, count(y) as ny, avg(x) filter (y is not null) as mx, avg(y) filter (x is not null) as my,
  var_pop(x) filter (y is not null) as vx, regr_slope(y, x) as s, regr_intercept(y, x) as i from j group by all),
c as (select *, case when vx = 0 then mx * my / (mx * mx + 1) else s end as a, case when vx = 0 then my / (mx * mx + 1) else i end as b from n),
h as (select j.*, n, ny, a, b, min(a * x + b) over (partition by area, category, variable) as low from j join c using (area, category, variable))"""


@query(f"with {_LS} select area, category, time, variable, round(case when y is not null then y when ny = 0 or n = 0 or low < 0 then x else a * x + b end) as value from h")
def compose_global_ls(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = StrategyDefinition([({}, strategies.GlobalLSStrategy()), ({}, strategies.SubstitutionStrategy())])
    cube = orders_cube(spark, sf_dir)
    return cells(compose.compose(cube.with_df(cube.df.where(F.col("source").isin("1-URGENT", "2-HIGH"))), _URGENT, plan), 0)


_TREND = f"""{ORDERS_SQL}, two as (select * from cube where source in ('1-URGENT', '2-HIGH')),
t as (select time, date_diff('day', date '1970-01-01', time)::double as d, row_number() over (order by time) as k from (select distinct time from two)),
g as (
  select s.*, t.*, y.value as y, x.value as x, count(y.value) over (partition by s.area, s.category, s.variable) as ny
  from (select distinct area, category, variable from two) s cross join t left join (select * from two where source = '1-URGENT') y using (area, category, variable, time)
    left join (select * from two where source = '2-HIGH') x using (area, category, variable, time)
), m as (select *, k - row_number() over (partition by area, category, variable order by k) as island from g where y is null and ny > 0),
gaps as (select area, category, variable, island, min(k) as k0, max(k) as k1, min(d) as d0, max(d) as d1, count(x) as nx from m group by all),
sides as (select gaps.*, side, t.d as d2, t.time as t2 from gaps cross join (select unnest([-1, 1]) as side) join t on t.k = case side when -1 then k0 - 1 else k1 + 1 end),
trends as (
  select area, category, variable, island, side, avg(y) as y0, avg(x) as x0, case when count(y) >= 5 then regr_intercept(y, d - d2) else avg(y) end as y1, case when count(x) >= 5 then regr_intercept(x, d - d2) else avg(x) end as x1
  from sides join g using (area, category, variable) where side = -1 and time between t2 - interval 9 month and t2 or side = 1 and time between t2 and t2 + interval 9 month group by all
), ends as (
  select area, category, variable, island, {", ".join(f"coalesce(max({v}) filter (side = {s}), max({v}) filter (side = {-s})) as {v}{n}" for v in ("y0", "x0", "y1", "x1") for s, n in ((-1, "l"), (1, "r")))} from trends group by all
), factors as (
  select area, category, variable, island, {", ".join(f"case when y{k}{n} = 0 then 0 when x{k}{n} <> 0 then y{k}{n} / x{k}{n} end as f{k}{n}" for k in "01" for n in "lr")} from ends
), usable as (
  select * from (select area, category, variable, island, case when f1l < 0 or f1r < 0 then f0l else f1l end as fl, case when f1l < 0 or f1r < 0 then f0r else f1r end as fr from factors) where fl >= 0 and fr >= 0
), filled as (
  select m.area, m.category, m.variable, m.time, x * (fl * (1 - w) + fr * w) as z
  from (select m.*, d0, d1, case when d1 > d0 then (d - d0) / (d1 - d0) else 0.5 end as w from m join gaps using (area, category, variable, island) where nx > 0) m join usable using (area, category, variable, island)
), h as (select g.*, z, count(z) over (partition by area, category, variable) as nz from g left join filled using (area, category, variable, time))"""


@query(f"with {_TREND} select area, category, time, variable, round(coalesce(y, case when nz > 0 then z else x end)) as value from h where coalesce(y, case when nz > 0 then z else x end) is not null")
def compose_local_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = StrategyDefinition([({}, strategies.LocalTrendsStrategy(strategies.FitParameters(trend_length_unit="MS"))), ({}, strategies.SubstitutionStrategy())])
    cube = orders_cube(spark, sf_dir)
    return cells(compose.compose(cube.with_df(cube.df.where(F.col("source").isin("1-URGENT", "2-HIGH"))), _URGENT, plan), 0)


@query(f"with {LINEITEM_SQL} select area, time, variable, 'composed' as source, arg_min(value, source) as value from cube where source in ('F', 'O') and time between '1996-01-01' and '1999-12-31' and variable <> 'SF6' group by area, time, variable")
def create_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = StrategyDefinition([({}, strategies.SubstitutionStrategy())])
    done = compose.create_composite_source(lineitem_cube(spark, sf_dir), _FO, plan, result_prio_coords={"source": {"value": "composed"}}, limit_coords={"variable": ["CO2", "CH4"]}, time_range=("1996", "1999"), metadata={"title": "composed"})
    return cells(done)


@query(f"""with {ORDERS_SQL}, t as (select distinct time from cube), s as (select distinct area, category, source, variable from cube),
d as (select s.*, t.time, value, row_number() over (partition by area, category, source, variable order by t.time) as k from s cross join t left join cube using (area, category, source, variable, time)),
m as (select *, k - row_number() over (partition by area, category, source, variable order by time) as island from d where value is null),
e as (select min(time) as t0, max(time) as t1 from t)
select area, category, source, variable, case when min(time) = any_value(t0) and max(time) = any_value(t1) then 'all' when min(time) = any_value(t0) then 'start' when max(time) = any_value(t1) then 'end' else 'gap' end as gap_type,
  min(time) as first, max(time) as last, count(*) as n_cells from m, e group by area, category, source, variable, island""")
def get_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.gaps(orders_cube(spark, sf_dir))


# --- tables -----------------------------------------------------------------------------------------------------------

_YEARS = list(range(1995, 2002))


@query(f"""with {LINEITEM_SQL} select area as "area (NATION)", variable as entity, source, 'Gg ' || variable || ' / yr' as unit, {", ".join(f'max(value) filter (year(time) = {y}) as "{y}"' for y in _YEARS)} from cube group by all""")
def wide_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.to_wide(tables.from_cube(lineitem_cube(spark, sf_dir)), [_day(y) for y in _YEARS])


@query(f"with {LINEITEM_SQL} select area, 'HISTORY' as scenario, source, variable as entity, 'Gg ' || variable || ' / yr' as unit, time, value from cube where variable <> 'CH4'")
def unpivot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = wide_pivot(spark, sf_dir).withColumnRenamed("area (NATION)", "nation")
    data = tables.convert_wide(
        wide,
        coords_cols={"area": "nation", "entity": "entity", "unit": "unit", "source": "source"},
        coords_terminologies={"area": "NATION", "scenario": "general"},
        coords_defaults={"scenario": "HISTORY"},
        filter_remove={"f": {"entity": "CH4"}},
        harmonize=False,
    )
    return data.df.where("value is not null").select("area", "scenario", "source", "entity", "unit", "time", "value")


@query("""select o_orderkey, case o_orderstatus when 'F' then 0.0 when 'P' then null else case o_orderkey % 4 when 0 then null when 1 then null else cast(o_orderkey as double) / 4 end end as value,
  o_orderstatus = 'O' and o_orderkey % 4 < 2 as unreadable from orders""")
def parse_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("o_orderkey") / 4).cast("string")
    odd = F.when(F.col("o_orderkey") % 4 == 0, F.concat(number, F.lit("d"))).when(F.col("o_orderkey") % 4 == 1, F.concat(number, F.lit("f")))
    text = F.when(F.col("o_orderstatus") == "F", "NE, IE").when(F.col("o_orderstatus") == "P", "NA,NE").otherwise(F.coalesce(odd, F.concat(number, F.lit(" (1)"))))
    value, bad = parse_code_column(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"), bad.alias("unreadable"))


@query("select l_orderkey, l_linenumber, concat(l_linenumber, '.', chr(65 + cast(l_partkey % 3 as int)), '.', 1 + l_suppkey % 9) as code from lineitem")
def map_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("l_partkey") % 3 + 1).cast("int"))
    raw = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("IPC"), F.col("l_linenumber"), letter, 1 + F.col("l_suppkey") % 9).alias("code"))
    return map_distinct(raw, ["code"], ["code"], ipcc_code).select("l_orderkey", "l_linenumber", "code")


@query(f"with {LINEITEM_SQL} select area, source, variable as entity, 'Gg ' || variable || ' / yr' as unit, time, case when source = 'F' then value * 0.001::double else value end as value from cube")
def harmonize_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = tables.from_cube(lineitem_cube(spark, sf_dir))
    mixed = data.df.withColumn("unit", F.when(F.col("source") == "F", F.concat(F.lit("t "), "entity", F.lit(" / yr"))).otherwise(F.col("unit")))
    return tables.harmonize_units(mixed).select("area", "source", "entity", "unit", "time", "value")


def _shared(spark: SparkSession, name: str) -> str:
    """A new place in the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="fluxcube-")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


@query(f"with {LINEITEM_SQL} select * from cube")
def interchange_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the two files of the interchange format; written twice, the bytes must agree."""
    folder = Path(_shared(spark, "interchange").removeprefix("file://").removeprefix("file:"))
    folder.mkdir(parents=True)
    data = tables.from_cube(lineitem_cube(spark, sf_dir))
    interchange.write_interchange(folder / "first", data)
    back = interchange.read_interchange(spark, folder / "first")
    interchange.write_interchange(folder / "second", back)
    if (folder / "first.csv").read_bytes() != (folder / "second.csv").read_bytes():
        raise ValueError("the interchange files differ")
    return cells(tables.to_cube(interchange.read_interchange(spark, folder / "second.yaml")))


_CODED = """case when source = 'F' and year(time) = 1996 then 0.0 when source = 'O' and year(time) = 1997 then null else value end"""


@query(f"with {LINEITEM_SQL} select area, source, time, variable as entity, 'Gg ' || variable || ' / yr' as unit, {_CODED} as value from cube where variable <> 'SF6' and {_CODED} is not null")
def read_wide_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file with a column for each year, notation keys among the numbers."""
    wide = wide_pivot(spark, sf_dir)
    for year, source, key in ((1996, "F", "NO, IE"), (1997, "O", "NE")):
        cell = F.col(f"`{year}`")
        wide = wide.withColumn(str(year), F.when(cell.isNotNull() & (F.col("source") == source), key).otherwise(cell.cast("string")))
    path = _shared(spark, "wide.csv")
    wide.withColumn("unit", F.lit("Gg")).write.csv(path, header=True)
    data = tables.read_wide_csv(
        spark,
        path,
        coords_cols={"area": "area (NATION)", "entity": "entity", "unit": "unit", "source": "source"},
        coords_terminologies={"area": "NATION"},
        coords_value_mapping={"unit": "COMPACT"},
        filter_remove={"f": {"entity": "SF6"}},
    )
    return data.df.where("value is not null").select("area", "source", "time", "entity", "unit", "value")


@query(f"""with {LINEITEM_SQL} select area, source, time, variable as entity, 'Gg ' || variable || ' / yr' as unit, case variable when 'CO2' then 'energy' when 'CH4' then 'farms' else 'other' end as category, value
from cube where time between '1995-01-01' and '1997-01-01'""")
def read_long_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file with a row for each cell; categories are filled in by gas."""
    path = _shared(spark, "long.csv")
    cube = lineitem_cube(spark, sf_dir)
    cube.df.select("area", "source", F.year("time").alias("year"), F.col("variable").alias("gas"), F.lit("Gg").alias("unit"), "value").where("year <= 1997 and year >= 1995").write.csv(path, header=True)
    data = tables.read_long_csv(
        spark,
        path,
        coords_cols={"area": "area", "entity": "gas", "unit": "unit", "source": "source", "time": "year", "data": "value"},
        coords_terminologies={"area": "NATION"},
        coords_defaults={"category": "other"},
        coords_value_mapping={"unit": "COMPACT"},
        coords_value_filling={"category": {"entity": {"CO2": "energy", "CH4": "farms"}}},
    )
    return data.df.select("area", "source", "time", "entity", "unit", "category", "value")


@query("""select l_orderkey, l_linenumber, case l_returnflag when 'A' then 'KYOTOGHG (SARGWP100)' when 'N' then 'HFCS (AR5CCFGWP100)' else 'CH4' end as entity,
  case l_linestatus when 'F' then 'kt CO2 / yr' else 't ' || case l_returnflag when 'A' then 'KYOTOGHG' when 'N' then 'HFCS' else 'CH4' end || ' / yr' end as unit from lineitem""")
def map_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    entity = F.when(flag == "A", "KYOTOGHG").when(flag == "N", "HFCSAR5CCF").otherwise("CH4")
    raw = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", entity.alias("entity"), F.when(F.col("l_linestatus") == "F", "kt CO\u2082eq").otherwise("t").alias("unit"))
    named = map_distinct(raw, ["entity"], ["entity"], entity_name)
    return map_distinct(named, ["unit", "entity"], ["unit"], unit_name).select("l_orderkey", "l_linenumber", "entity", "unit")


@query(f"with {LINEITEM_SQL} select area, variable as entity, 'Gg' as unit, '1997' as time, cast(cast(value as bigint) as varchar) as data from cube where year(time) = 1997 and source = 'O'")
def inventory_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = lineitem_cube(spark, sf_dir)
    sheet = cube.df.where((F.year("time") == 1997) & (F.col("source") == "O")).groupBy("area").pivot("variable", ["CO2", "CH4", "SF6"]).agg(F.first(F.col("value").cast("long")))
    header = [("area", ""), *inventory.header_units(["CO2 emissions", "CH4 emissions", "SF6 emissions"], regexp_entity=r"^(\w+)", default_unit="Gg")]
    return inventory.sheet_to_long(inventory.add_units(sheet, header), 1997, ["area"]).where("data is not null")


@query(f"with {LINEITEM_SQL} select * from cube where variable = 'CH4' and time >= '1998-01-01'")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _shared(spark, "store")
    store.save_cube(lineitem_cube(spark, sf_dir), path)
    back = store.open_cube(spark, path).variable("CH4")
    return cells(select.loc(back, {"time": slice("1998", None)}))


@query(f"""with {LINEITEM_SQL}, faulty as (
  select case area when 'NATION_3' then 'guess' else 'measured' end as provenance, area, source, case area when 'NATION_2' then null else time end as time,
    case when variable = 'SF6' and source = 'O' then 'XX' else variable end as variable, case when cast(value as bigint) % 10 = 3 then 'nan'::double else value end as value, area = 'NATION_1' as again
  from cube
), c as (select provenance, area, source, time, variable, sum(1 + again::int) as n, sum((1 + again::int) * isnan(value)::int) as nan from faulty group by all)
select cast(sum(nan) as bigint) as nan_values, count(*) filter (variable = 'XX') as unknown_variables, count(*) filter (n > 1) as duplicate_cells, count(*) filter (time is null) as missing_times,
  count(*) filter (provenance = 'guess') as bad_provenance from c""")
def validate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube with faults of every kind."""
    cube = select.expand_dims(lineitem_cube(spark, sf_dir), "provenance", "measured")
    faults = {
        "value": F.when(F.col("value").cast("long") % 10 == 3, float("nan")).otherwise(F.col("value")),
        "variable": F.when((F.col("variable") == "SF6") & (F.col("source") == "O"), "XX").otherwise(F.col("variable")),
        "provenance": F.when(F.col("area") == "NATION_3", "guess").otherwise(F.col("provenance")),
        "time": F.when(F.col("area") != "NATION_2", F.col("time")),
    }
    df = cube.df.withColumns(faults)
    return validate.row_report(cube.with_df(df.union(df.where("area = 'NATION_1'"))))


@query("select event_type, cast(ts as date) as time, cast(sum(cast(floor(value) as bigint)) as bigint) as value, count(*) as n from events group by all")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of four files in any order, so none may be too late; late ones change windows that were written before."""
    folder, path = _shared(spark, "events"), _shared(spark, "totals")
    events = table(spark, sf_dir, "events").select("event_type", "ts", F.floor("value").cast("long").alias("v"))
    events.repartitionByRange(4, "ts").write.parquet(folder)
    stream = ingest.read_events(spark, folder, "event_type string, ts timestamp, v long", files_per_trigger=1)
    totals = ingest.windowed_totals(stream, "ts", "v", ["event_type"], late="3650 days")
    ingest.upsert_into(totals, path, _shared(spark, "checkpoint")).awaitTermination()
    return ingest.read_upserts(spark, path, "event_type string, time date, value long, n long", ["event_type"])


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: totals, downscaled to categories, without one of them, summed by area and year."""
    cube = downscale.downscale_timeseries(_with_total(spark, sf_dir), "category", "TOTAL", _PARTS)
    part = select.loc(cube, {"category": Not(["TOTAL", "BUILDING"]), "time": slice("1996", "1998")}, check=False)
    return cells(aggregate.sum_cells(part, reduce_to_dim=["area", "time"], skipna=True))


__all__ = ["ORACLES", "QUERIES", "entry_query"]
