"""Cubes over relational tables; values are whole numbers, so that sums don't depend on their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxcube.cube import Cube
from fluxcube.meta import CubeMeta, VariableMeta

CO2, CH4, SF6 = (VariableMeta(g, f"Gg {g} / yr") for g in ("CO2", "CH4", "SF6"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _meta(dims: tuple[str, ...], variables: dict[str, VariableMeta]) -> CubeMeta:
    terms = {"area": "area (NATION)", "category": "category (SEGMENT)", "source": "source"}
    return CubeMeta(dims, variables, {d: terms[d] for d in dims}, {"area": terms["area"], "cat": terms["category"]} if "category" in dims else {"area": terms["area"]})


def orders_cube(spark: SparkSession, sf_dir: str) -> Cube:
    """Months; area: the customer's nation, category: market segment, source: priority; one variable, CO2.

    Orders are summed by customer before the join, which is what shrinks its larger side.
    """
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("time"), F.col("o_orderpriority").alias("source")).agg(F.sum(F.floor("o_totalprice").cast("long")).alias("v"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("category"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("area"))
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    df = joined.groupBy("area", "category", "source", "time").agg(F.sum("v").cast("double").alias("value"))
    return Cube(df.select("area", "category", "source", "time", F.lit("CO2").alias("variable"), "value"), _meta(("area", "category", "source"), {"CO2": CO2}))


ORDERS_SQL = """cube as (
  select n_name as area, c_mktsegment as category, o_orderpriority as source, cast(date_trunc('month', o_orderdate) as date) as time, 'CO2' as variable,
    cast(sum(cast(floor(o_totalprice) as bigint)) as double) as value
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all
)"""


def lineitem_cube(spark: SparkSession, sf_dir: str) -> Cube:
    """Years; area: the supplier's nation, source: line status; gases by return flag: A is CO2, N is CH4, R is SF6."""
    gas = F.when(F.col("l_returnflag") == "A", "CO2").when(F.col("l_returnflag") == "N", "CH4").otherwise("SF6")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.trunc("l_shipdate", "year").alias("time"), F.col("l_linestatus").alias("source"), gas.alias("variable")).agg(F.sum(F.floor("l_quantity").cast("long")).alias("v"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("area"))
    joined = lines.join(supplier, lines["l_suppkey"] == supplier["s_suppkey"]).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    df = joined.groupBy("area", "source", "time", "variable").agg(F.sum("v").cast("double").alias("value"))
    return Cube(df.select("area", "source", "time", "variable", "value"), _meta(("area", "source"), {"CO2": CO2, "CH4": CH4, "SF6": SF6}))


LINEITEM_SQL = """cube as (
  select n_name as area, l_linestatus as source, cast(date_trunc('year', l_shipdate) as date) as time,
    case l_returnflag when 'A' then 'CO2' when 'N' then 'CH4' else 'SF6' end as variable, cast(sum(cast(floor(l_quantity) as bigint)) as double) as value
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by all
)"""


def events_cube(spark: SparkSession, sf_dir: str) -> Cube:
    """Days; area: the user, category: the event type; sparse."""
    df = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("area"), F.col("event_type").alias("category"), F.to_date("ts").alias("time")).agg(F.sum(F.floor("value").cast("long")).cast("double").alias("value"))
    return Cube(df.select("area", "category", "time", F.lit("CO2").alias("variable"), "value"), _meta(("area", "category"), {"CO2": CO2}))


EVENTS_SQL = """cube as (
  select cast(user_id as varchar) as area, event_type as category, cast(ts as date) as time, 'CO2' as variable, cast(sum(cast(floor(value) as bigint)) as double) as value
  from events group by all
)"""
