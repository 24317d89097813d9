"""Prefixes, selections, checks and paths over the test tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewinds.functions import scalars as S
from tradewinds.operators import causal as C
from tradewinds.operators import experiment as X
from tradewinds.operators import metrics as M
from tradewinds.plans import forecasts, graphs, studies
from tradewinds.plans.base import PANEL, panel, read
from tradewinds.plans.forecasts import BASELINES, base
from tradewinds.plans.studies import CUT
from tradewinds.sources import raw as R

D = "::decimal(18,2)"


def _codes(s, d):
    code = F.when(F.col("p_partkey") % 10 != 0, F.format_string("%08d", (F.col("p_partkey") * 7919) % 100000000))
    return read(s, d, "part").select("p_partkey", code.alias("code"), "p_type", "p_name")


def _log(s, d):
    return read(s, d, "orders").groupBy(F.col("o_orderstatus").alias("kind"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("rows"), F.sum(F.when(F.col("o_orderkey") % 3 == 0, 1)).alias("lines_joined"))


def _trajectory(s, d):
    return X.trajectory(studies.QUERIES["exp01_opportunities"](s, d), panel(s, d).where("segment = 'bienes'"), "1999")


def _pairs(s, d):
    """Pairs of the balanced panel before the cut against all its pairs: the panel holds pairs with value before the cut only, so none differ."""
    rows = studies.balanced(s, d)
    before = rows.where("t < {} and v > 0".format(CUT)).select("product", "partner").distinct()
    return C.pairs_differ(before, rows.select("product", "partner").distinct())


def _components_sql():
    return f"""with recursive {graphs.FULL}, reach as (select distinct p as product, p as c from bw union select bw.q as product, reach.c from reach join bw on bw.p = reach.product)
  select product, min(c) as component from reach group by product"""


QUERIES = {
    "prj03_prefixes": lambda s, d: _codes(s, d).select("p_partkey", *S.prefixes(F.col("code"))),
    "prj07_starts_with": lambda s, d: _codes(s, d).where(S.starts_with(F.col("code"), "00", "01")).select("p_partkey"),
    "prj11_scaled": lambda s, d: panel(s, d).groupBy("t").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("v")).select("t", F.round(S.scaled(F.col("v"), 1e6), 6).alias("millions"), F.round(S.scaled(F.col("v"), 1e3), 6).alias("thousands")),
    "scl06_title": lambda s, d: _codes(s, d).select("p_partkey", S.title(F.concat(F.lit("THE "), F.col("p_type"), F.lit(" OF THE "), F.col("p_name"))).alias("title")),
    "agg35_log_totals": lambda s, d: R.log_totals(_log(s, d), ["rows", "lines_joined"]),
    "agg36_coverage": forecasts.QUERIES["fea24_history"],
    "agg32_unit_values": lambda s, d: C.monthly_unit_values(panel(s, d), ["Brand#2", "Brand#3"], ["1", "7"]).select("t", *[F.round(c, 4).alias(c) for p in "17" for c in (f"value_{p}", f"quantity_{p}", f"unit_{p}")]),
    "jon04_trajectory": _trajectory,
    "set05_pairs": _pairs,
    "srt07_hits": lambda s, d: M.hits(base(s, d).where("t = 23990").withColumn("on", (F.col("y") > 0).cast("int")), "mean_3", "on", ["product", "partner"]).select("product", "partner", "mean_3"),
}

_SMALL = "'of', 'and', 'the'"
_MONTHS = ", ".join(f"coalesce(sum(greatest(value, 0){D}) filter (period between '1999-01' and '1999-{m:02d}'), 0)::double as m{m:02d}" for m in range(1, 13))
_UNITS = ", ".join(f"round(coalesce(sum(value{D}) filter (partner = '{p}'), 0)::double, 4) as value_{p}, round(coalesce(sum(quantity{D}) filter (partner = '{p}'), 0)::double, 4) as quantity_{p}, round(case when sum(quantity{D}) filter (partner = '{p}') > 0 then sum(value{D}) filter (partner = '{p}')::double / sum(quantity{D}) filter (partner = '{p}')::double end, 4) as unit_{p}" for p in "17")
_CODES = "codes as (select p_partkey, case when p_partkey % 10 <> 0 then lpad(((p_partkey * 7919) % 100000000)::varchar, 8, '0') end as code, p_type, p_name from part)"
ORACLE = {
    "prj03_prefixes": f"with {_CODES} select p_partkey, coalesce(code[1:6], '000000') as hs6, coalesce(code[1:2], '00') as chapter, coalesce(code[1:4], '0000') as hs4 from codes",
    "prj07_starts_with": f"with {_CODES} select p_partkey from codes where code like '00%' or code like '01%'",
    "prj11_scaled": f"with {PANEL} select t, round(sum(value{D})::double / 1e6, 6) as millions, round(sum(value{D})::double / 1e3, 6) as thousands from panel group by t",
    "scl06_title": f"with {_CODES} select p_partkey, array_to_string(list_transform(string_split(lower('THE ' || p_type || ' OF THE ' || p_name), ' '), lambda w, i: case when i > 1 and w in ({_SMALL}) then w else upper(w[1]) || w[2:] end), ' ') as title from codes",
    "agg35_log_totals": "select o_orderstatus as kind, count(*) as rows, count(*) filter (o_orderkey % 3 = 0) as lines_joined from orders group by 1",
    "agg36_coverage": forecasts.ORACLE["fea24_history"],
    "agg32_unit_values": f"""with {PANEL}, gp as (select * from panel where segment = 'bienes' and not pseudo and product <> '000000')
  select m.t::int as t, {_UNITS} from (select unnest(range((select min(t) from gp), (select max(t) from gp) + 1)) as t) m left join (select * from gp where product in ('Brand#2', 'Brand#3')) g on g.t = m.t group by m.t""",
    "jon04_trajectory": f"""with {BASELINES}, c as (select product, partner, mean_3 as score from baselines where t = 23990 order by mean_3 desc, product, partner limit 200)
  select c.product, c.partner, score, coalesce(sum(greatest(value, 0){D}) filter (period like '1998%'), 0)::double as value_a, coalesce(sum(greatest(value, 0){D}) filter (period like '1999%'), 0)::double as value_b,
    count(distinct case when period like '1998%' then period end) as months_a, {_MONTHS}, true as consistent
  from c left join (select * from panel where segment = 'bienes') p on p.product = c.product and p.partner = c.partner group by 1, 2, 3""",
    "set05_pairs": "select 0::bigint as only_first, 0::bigint as only_second",
    "srt07_hits": f"with {BASELINES}, a as (select product, partner, mean_3, y from baselines where t = 23990 order by mean_3 desc, product, partner limit 100) select product, partner, mean_3 from a where y > 0 order by mean_3 desc, product, partner limit 10",
    "grf10_components": _components_sql(),
    "exp07_assign": f"""with {studies._UNITS}, ca as (select product || '_' || partner as c, avg(score) as m from units group by 1), cb as (select *, row_number() over (order by m, c) as r, count(*) over () as n from ca),
  cc as (select c, greatest(1, ceil((r - 1) * 4 / greatest(1, n - 1)))::int as stratum from cb),
  cd as (select *, row_number() over (partition by stratum order by md5(c || '0'), c) as k, count(*) over (partition by stratum) as mm from cc)
  select c, stratum, case when k <= round_even(mm * 0.5, 0) then 'C' when k <= round_even(mm * 0.75, 0) then 'A' else 'B' end as arm from cd""",
    "exp23_unit_costs": f"""with {studies._CM}, x as (select a.arm, case a.arm when 'A' then 10.0 else 20.0 end::double as cost, a.m - c.m as effect, sqrt(a.v + c.v) as se from mv a join mv c on c.arm = 'C' where a.arm <> 'C')
  select arm, cost, round(case when effect > 0 then cost / effect end, 3) as per_outcome, round(case when effect - 1.96 * se > 0 then cost / (effect + 1.96 * se) end, 3) as lo, round(case when effect - 1.96 * se > 0 then cost / (effect - 1.96 * se) end, 3) as hi from x""",
    "drf14_alert_counts": f"with {studies._CTL}, f as (select t, case when s = 'warn' and lag(s) over (order by t) = 'warn' and sign(lag(z) over (order by t)) = sign(z) then 'alert' else s end as status from st) select 'status' as layer, count(*) filter (status = 'warn') as warn, count(*) filter (status = 'alert') as alert from f where t >= {CUT}",
}
