"""The test tables as items, and the SQL of the same steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewinds import roles
from tradewinds.operators import panel as P

ROLES = roles.Roles(
    date="o_orderdate",
    decl="l_orderkey",
    item="l_linenumber",
    # one in 97 values is taken out, so that there is something to impute
    item_value="case when (l_orderkey * 31 + l_linenumber * 7) % 97 = 0 then null else l_extendedprice end",
    header_value="o_totalprice",
    qty="l_quantity",
    product="p_brand",
    chapter="p_type",
    partner="cast(c_nationkey as string)",
    trader="l_suppkey",
    segment="case o_orderstatus when 'F' then 'bienes' when 'O' then 'servicios' when 'P' then 'rancho' else 'otros' end",
    pseudo="c_nationkey >= 22",
    extra={"region": "c_nationkey % 5"},
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.items(_joined(spark, sf_dir), ROLES)


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read(spark, sf_dir, n)
    return (
        t("lineitem").join(t("orders"), F.expr("l_orderkey = o_orderkey")).join(t("part"), F.expr("l_partkey = p_partkey")).join(t("customer"), F.expr("o_custkey = c_custkey"))
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.panel(items(spark, sf_dir))


ITEMS = """items as (
  select strftime(o_orderdate, '%Y-%m') as period, (year(o_orderdate) * 12 + month(o_orderdate))::int as t, l_orderkey as decl, l_linenumber as item,
    case when (l_orderkey * 31 + l_linenumber * 7) % 97 = 0 then null else l_extendedprice end as item_value, o_totalprice as header_value, l_quantity as qty,
    p_brand as product, p_type as chapter, c_nationkey::varchar as partner, l_suppkey as trader, c_nationkey >= 22 as pseudo, c_nationkey % 5 as region,
    case o_orderstatus when 'F' then 'bienes' when 'O' then 'servicios' when 'P' then 'rancho' else 'otros' end as segment
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join customer on o_custkey = c_custkey
)"""
IMPUTED = ITEMS + """, marked as (
  select *, count(*) filter (item_value is null) over w as k, coalesce(sum(item_value::decimal(18,2)) over w, 0) as known from items window w as (partition by period, decl)
), done as (
  select * replace (case when item_value is null and k = 1 and header_value is not null then (header_value::decimal(18,2) - known)::double else item_value end as item_value),
    item_value is null and k = 1 and header_value is not null as imputed from marked
)"""
PANEL = IMPUTED + """, panel as (
  select period, t, segment, product, partner, coalesce(sum(item_value::decimal(18,2)), 0)::double as value, coalesce(sum(qty::decimal(18,2)), 0)::double as quantity,
    count(*) as n_items, count(distinct decl) as n_decl, count(distinct trader) as n_firms, any_value(pseudo) as pseudo, min(chapter) as chapter
  from done where item_value is not null group by period, t, segment, product, partner
)"""
FIRMS = ITEMS + """, fp as (
  select period, trader, product, sum(item_value::decimal(18,2))::double as v from items where segment = 'bienes' group by period, trader, product
)"""
