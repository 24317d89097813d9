"""Queries over items and panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewinds.operators import eda as E
from tradewinds.operators import panel as P
from tradewinds.plans.base import FIRMS, IMPUTED, ITEMS, PANEL, items, panel, read

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def firm_products(spark, d):
    return items(spark, d).where("segment = 'bienes'").dropna(subset=["trader"]).groupBy("period", "trader", "product").agg(F.sum(P.money("item_value")).cast("double").alias("v"))


def over_panel(name, sql, op, *args, **kw):
    query(name, f"with {PANEL}, " + sql if sql.startswith("--") else f"with {PANEL} {sql}")(lambda s, d: op(panel(s, d), *args, **kw))


def over_items(name, sql, op, *args, **kw):
    query(name, f"with {ITEMS} {sql}")(lambda s, d: op(items(s, d), *args, **kw))


D = "::decimal(18,2)"
query("agg01_panel", f"with {PANEL} select * from panel")(panel)
query("agg02_imputation", f"""with {IMPUTED} select count(*) filter (item_value is null or imputed) as null_items, count(*) filter (imputed) as imputed,
  coalesce(sum(case when imputed then item_value{D} end), 0)::double as imputed_value from done""")(lambda s, d: P.imputation_report(items(s, d)))
over_panel("agg03_panel_stats", f"select count(*) as n_cells, sum(n_items)::bigint as n_rows, sum(value{D})::double as value from panel",
           lambda p: p.agg(F.count("*").alias("n_cells"), F.sum("n_items").alias("n_rows"), P.total("value").alias("value")))
over_items("agg04_modal_label", f"""select product, label from (select product, chapter as label, row_number() over (partition by product order by coalesce(sum(item_value{D}), 0) desc, chapter desc) as r
  from items where length(chapter) >= 3 group by product, chapter) where r = 1""", E.modal_label)
over_panel("agg09_yearly", f"select substr(period, 1, 4) as year, sum(value{D})::double as value, coalesce(sum(value{D}) filter (segment = 'bienes'), 0)::double as goods from panel group by 1", E.yearly)
over_panel("agg10_segment_share", f"select segment, sum(value{D})::double as value, round(100 * sum(value{D})::double / sum(sum(value{D})::double) over (), 6) as share from panel group by 1", E.segment_share)
over_items("agg11_header_inflation", f"""select sum(item_value{D})::double as right_total, sum(header_value{D})::double as wrong_total,
  (select quantile_cont(n::double, 0.5) from (select count(*) as n from items group by decl)) as median_items, (select max(n) from (select count(*) as n from items group by decl)) as max_items,
  round(sum(header_value{D})::double / sum(item_value{D})::double, 6) as factor from items""", E.header_inflation)
over_panel("agg12_monthly", f"select period, sum(value{D})::double as value from panel group by 1", E.monthly)
over_panel("agg13_year_to_date", f"""select year, value, round(100 * (value / lag(value) over (order by year) - 1), 6) as growth from
  (select substr(period, 1, 4) as year, sum(value{D})::double as value from panel where substr(period, 6, 2)::int <= 8 group by 1)""", E.year_to_date)
over_panel("agg14_contribution", f"""select chapter, before, after, delta, change from (select *, row_number() over (order by delta desc, chapter) as u, row_number() over (order by delta, chapter) as d from
  (select *, round(after - before, 2) as delta, round(case when before > 0 then 100 * (after / before - 1) end, 6) as change from
  (select chapter, coalesce(sum(value{D}) filter (period like '1999%'), 0)::double as before, coalesce(sum(value{D}) filter (period like '2000%'), 0)::double as after
   from panel where substr(period, 1, 4) in ('1999', '2000') group by 1))) where u <= 2 or d <= 2""", E.contribution, "1999", "2000", 2, 2)
over_panel("agg15_price_volume", f"""select b.period, round(100 * uv / b_uv, 6) as price, round(100 * q / b_q, 6) as volume, round(avg(100 * q / b_q) over (order by b.period rows between 2 preceding and current row), 6) as volume_rolled
  from (select period, sum(value{D})::double / sum(quantity{D})::double as uv, sum(quantity{D})::double as q from panel group by 1) b,
  (select avg(uv) as b_uv, avg(q) as b_q from (select sum(value{D})::double / sum(quantity{D})::double as uv, sum(quantity{D})::double as q from panel where period like '1999%' group by period))""", E.price_volume, "1999")
over_panel("agg16_chapter_shares", f"""select key as chapter, round(sum(value), 2) as value, round(100 * round(sum(value), 2) / sum(round(sum(value), 2)) over (), 6) as share from
  (select case when row_number() over (order by sum(value{D}) desc, chapter) <= 3 then chapter else 'rest' end as key, sum(value{D})::double as value from panel group by chapter) group by key""", E.top_shares, "chapter", 3)
over_panel("agg17_top_partners", f"""select key as partner, round(sum(value), 2) as value, round(100 * round(sum(value), 2) / sum(round(sum(value), 2)) over (), 6) as share from
  (select case when not e and row_number() over (order by e, value desc, partner) <= 10 then partner else 'rest' end as key, value from
  (select partner, bool_or(pseudo) as e, sum(value{D})::double as value from panel group by partner)) group by key""", lambda p: E.top_shares(p, "partner", 10, ~F.col("pseudo")))
over_panel("agg18_concentration", f"""select product, value, row_number() over (order by value desc, product) as rank, round(100 * sum(value{D}) over (order by value desc, product)::double / sum(value{D}) over ()::double, 6) as cumulative
  from (select product, sum(value{D})::double as value from panel group by 1)""", E.concentration, "product")
over_panel("agg18_concentration_summary", f"""select min(rank) filter (cumulative >= 80) as n80, min(rank) filter (cumulative >= 95) as n95, max(cumulative) filter (rank <= greatest(1, n // 10)) as top_tenth from
  (select row_number() over (order by value desc, product) as rank, round(100 * sum(value{D}) over (order by value desc, product)::double / sum(value{D}) over ()::double, 6) as cumulative, count(*) over () as n
  from (select product, sum(value{D})::double as value from panel group by 1))""", E.concentration_summary, "product")
over_items("agg19_firm_concentration", f"""select period, round(10000 * sum(s * s), 4) as hhi, round(100 * sum(case when r <= 10 then s else 0.0 end), 6) as top_share from
  (select period, v / sum(v) over (partition by period) as s, row_number() over (partition by period order by v desc, trader) as r from
  (select period, trader, coalesce(sum(item_value{D}), 0)::double as v from items where trader is not null group by 1, 2)) group by period""", E.firm_concentration)
over_items("agg20_id_stability", """, p as (select distinct period, trader, region from items where trader is not null)
  select (select round(100 * avg((k = 1)::int::double), 6) from (select count(distinct region) as k from p group by period, trader)) as within_month,
  (select round(100 * avg((k = 1)::int::double), 6) from (select count(distinct region) as k from p group by trader having count(distinct period) > 1)) as across_months,
  (select round(quantile_cont(x, 0.5), 6) from (select max(trader) / count(distinct trader) as x from p group by period)) as id_ratio""", E.id_stability, "region")
over_panel("agg21_intermittency", f"""select bin, series, round(100 * series / sum(series) over (), 6) as series_share, round(100 * v / sum(v) over (), 6) as value_share from
  (select b.bin::int as bin, count(s.m) as series, coalesce(sum(s.v), 0.0) as v from (values (0, 0, 12), (1, 12, 24), (2, 24, 48), (3, 48, 80), (4, 80, 200)) b(bin, lo, hi)
   left join (select count(distinct period) as m, sum(value{D})::double as v from panel group by product, partner) s on s.m > b.lo and s.m <= b.hi group by 1)""", E.intermittency, [0, 12, 24, 48, 80, 200])
over_items("agg22_describe", """select count(item_value) as n, round(avg(item_value), 6) as mean, round(stddev_samp(item_value), 4) as sd, min(item_value) as least, round(quantile_cont(item_value, 0.5), 6) as p50,
  round(quantile_cont(item_value, 0.9), 6) as p90, round(quantile_cont(item_value, 0.99), 6) as p99, round(quantile_cont(item_value, 0.999), 6) as p999, max(item_value) as most from items""", E.describe, "item_value")
over_items("agg23_log_histogram", f"""select bin, n, round(100 * n / sum(n) over (), 6) as share from (select floor(log10(item_value) / {9.5 / 79})::int as bin, count(*) as n from items where item_value >= 1 group by 1)""", E.log_histogram, "item_value")
over_items("agg24_quality_checks", f""", dd as (select period, decl, coalesce(sum(item_value{D}), 0)::double as s, max(header_value) as h, count(*) filter (item_value is null) as k from items group by 1, 2)
  select (select sum(n - 1)::bigint from (select count(*) as n from items group by period, decl, item)) as duplicates, (select count(*) from items where item_value is null) as null_items,
  (select count(*) from items where item_value < 0) as negative_items, count(*) filter (abs(s - h) > 0.01 * abs(h)) as off, count(*) filter (abs(s - h) > 0.01 * abs(h) and k > 0) as off_with_null,
  round(100 * avg((not abs(s - h) > 0.01 * abs(h))::int::double), 6) as consistent from dd""", E.quality_checks)
query("agg05_firm_products", f"with {FIRMS} select period, trader, product, v from fp where v >= 30000")(lambda s, d: firm_products(s, d).where("v >= 30000"))
query("agg27_generalists", f"""with {FIRMS}, k as (select count(*) as k, count(*) * (count(*) - 1) / 2 as p from fp group by period, trader)
  select l.x::int as more_than, round(100 * avg((k > x)::int::double), 6) as firm_months, round(100 * sum(case when k > x then p else 0 end) / nullif(sum(p), 0), 6) as pairs from k, (values (1), (3), (5)) l(x) group by 1""")(
    lambda s, d: E.generalists(firm_products(s, d), [1, 3, 5]))
query("prj13_threshold_sweep", f"""with {FIRMS}, x as (select l.x, period, trader, count(*) filter (v >= x) as k, count(*) as n, sum(v{D}) as v, coalesce(sum(v{D}) filter (v >= x), 0) as kv
  from fp, (values (0), (10000), (30000), (60000)) l(x) where v is not null group by 1, 2, 3)
  select x::int as least, sum(k)::bigint as pairs, round(100 * (1 - sum(k) / sum(n)), 6) as removed, round(100 * sum(kv)::double / sum(v)::double, 6) as value_kept,
  round(100 * count(*) filter (k = 1) / nullif(count(*) filter (k > 0), 0), 6) as single from x group by 1""")(lambda s, d: E.threshold_sweep(firm_products(s, d).dropna(subset=["v"]), [0, 10000, 30000, 60000]))
query("agg28_flows", f"""with {PANEL}, c as (select distinct product, (substr(product, -1)::int % 3)::int as community from panel),
  big as (select partner from panel group by 1 order by sum(value{D}) desc, partner limit 5),
  m as (select community, case when partner in (select partner from big) then partner else 'rest' end as market, sum(value{D})::double as value from panel join c using (product) group by 1, 2),
  s as (select *, value / sum(value) over (partition by community) as s from m)
  select community, round(1 / sum(s * s), 6) as effective, arg_max(market, value) as main, round(max(s), 6) as main_share, round(sum(value), 2) as value from s group by 1""")(
    lambda s, d: E.flows(panel(s, d), panel(s, d).select("product", (F.substring("product", -1, 1).cast("int") % 3).alias("community")).distinct(), 5))
over_panel("win05_autocorrelation", f""", r as (select product, partner, period, ln(1 + greatest(sum(value{D})::double, 0)) as x from panel group by 1, 2, 3),
  l as (select product, partner, x, lag(x, 1) over w as l1, lag(x, 12) over w as l12 from r window w as (partition by product, partner order by period)),
  c as (select corr(x, l1) as c1, corr(x, l12) as c12 from l group by product, partner)
  select round(avg(c1) filter (not isnan(c1)), 4) as lag1, round(avg(c12) filter (not isnan(c12)), 4) as lag12 from c""", E.autocorrelation, [1, 12])
over_panel("srt02_largest_cells", "select period, segment, product, partner, value from panel order by value desc, period, segment, product, partner limit 5",
           lambda p: p.select("period", "segment", "product", "partner", "value").orderBy(F.desc("value"), "period", "segment", "product", "partner").limit(5))
over_panel("jon11_names", "select p.period, coalesce(n_name, p.partner) as name, sum(p.n_items)::bigint as n from panel p left join nation on p.partner = n_nationkey::varchar and n_nationkey < 20 group by 1, 2", lambda p: p)
QUERIES["jon11_names"] = lambda s, d: panel(s, d).join(F.broadcast(read(s, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("partner"), "n_name")), "partner", "left").groupBy("period", F.coalesce("n_name", "partner").alias("name")).agg(F.sum("n_items").alias("n"))
