"""Queries of drift, experiments, causal estimates and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewinds.operators import causal as C
from tradewinds.operators import drift as R
from tradewinds.operators import experiment as X
from tradewinds.operators import splits as S
from tradewinds.plans.base import ITEMS, PANEL, items, panel
from tradewinds.plans.forecasts import BASELINES, FEATURES, GRID, activity, base, frame, grid

QUERIES, ORACLE = {}, {}
D = "::decimal(18,2)"
CUT = 1999 * 12 + 1  # reference before January 1999
FEATS = ["lag_0", "mean_log_3", "sd_log_12", "growth_3m", "price_gap"]


def _r(df, *cols, k=6):
    return df.withColumns({c: F.round(c, k) for c in cols})


_LONG = f", longf as (select cur, feature, x from (select (t >= {CUT})::int as cur, " + ", ".join(f"round({f}::double, 6) as {f}" for f in FEATS) + f" from features where t >= {CUT - 24}) unpivot include nulls (x for feature in ({', '.join(FEATS)})))"
_PSI = _LONG + """, e as (select feature, list_sort(list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) as e from longf where cur = 0 group by feature),
  bn as (select l.feature, cur, case when x is null then -1 else len(list_filter(e[2:len(e) - 1], lambda c: c <= x)) end as b, len(e) > 1 as ok from longf l join e using (feature)),
  sh as (select feature, b, bool_and(ok) as ok, count(*) filter (cur = 0) as r, count(*) filter (cur = 1) as c from bn group by 1, 2),
  s2 as (select feature, ok, greatest(1e-4, r / sum(r) over (partition by feature)) as r, greatest(1e-4, c / sum(c) over (partition by feature)) as c from sh),
  ps as (select feature, case when bool_and(ok) then sum((c - r) * ln(c / r)) end as psi from s2 group by 1),
  kn as (select feature, x, count(*) filter (cur = 0) as r, count(*) filter (cur = 1) as c from longf where x is not null group by 1, 2),
  kd as (select feature, abs(sum(r) over (partition by feature order by x) / sum(r) over (partition by feature) - sum(c) over (partition by feature order by x) / sum(c) over (partition by feature)) as d from kn),
  kk as (select feature, max(d) as ks from kd group by 1)"""
QUERIES["drf06_feature_drift"] = lambda s, d: _r(R.feature_drift(_r(frame(s, d).where(f"t >= {CUT - 24}"), *FEATS), FEATS, F.col("t") >= CUT), "psi", "ks", k=5)
ORACLE["drf06_feature_drift"] = f"with {FEATURES}{_PSI} select feature, round(psi, 5) as psi, round(ks, 5) as ks from ps full join kk using (feature)"
QUERIES["drf02_chapter_mix"] = lambda s, d: _r(R.psi_categorical(grid(s, d).select(F.col("chapter").alias("x"), F.col("v").alias("w"), (F.col("t") >= CUT).cast("int").alias("cur"))), "psi")
ORACLE["drf02_chapter_mix"] = f"with {GRID}, a as (select chapter, sum(case when t < {CUT} then v else 0 end) as r, sum(case when t >= {CUT} then v else 0 end) as c from grid group by 1), b as (select greatest(1e-4, r / sum(r) over ()) as r, greatest(1e-4, c / sum(c) over ()) as c from a) select round(sum((c - r) * ln(c / r)), 6) as psi from b"
_PRICE = GRID + f""", uvs as (select *, case when q > 0 and v > 0 then v / q end as uv from grid), md as (select product, partner, quantile_cont(uv, 0.5) as m from uvs where t < {CUT} group by 1, 2),
  price as (select t, 100 * (exp(sum(v * ln(uv / m)) / sum(v)) - 1) as price from uvs join md using (product, partner) where uv is not null and m is not null group by t)"""


def price(s, d):
    return R.price_index(grid(s, d), F.col("t") < CUT)


QUERIES["drf07_price_index"] = lambda s, d: _r(price(s, d), "price")
ORACLE["drf07_price_index"] = f"with {_PRICE} select t, round(price, 6) as price from price"
QUERIES["drf11_price_status"] = lambda s, d: price(s, d).select("t", R.level(F.col("price"), 1, 2).alias("status"))
ORACLE["drf11_price_status"] = f"with {_PRICE} select t, case when abs(price) > 2 then 'alert' when abs(price) > 1 then 'warn' else 'ok' end as status from price"
_CTL = _PRICE + f""", zz as (select t, price as x, (price - mu) / sd as z from price, (select avg(price) as mu, stddev_samp(price) as sd from price where t < {CUT})), st as (select *, case when abs(z) > 3 then 'alert' when abs(z) > 2 then 'warn' else 'ok' end as s from zz)"""


def control(s, d):
    return R.control_status(price(s, d).withColumnRenamed("price", "x"), F.col("t") < CUT)


QUERIES["drf09_control_chart"] = lambda s, d: _r(control(s, d), "x", "z")
ORACLE["drf09_control_chart"] = f"with {_CTL} select t, round(x, 6) as x, round(z, 6) as z, case when s = 'warn' and lag(s) over (order by t) = 'warn' and sign(lag(z) over (order by t)) = sign(z) then 'alert' else s end as status from st"
QUERIES["drf14_alert_counts"] = lambda s, d: R.count_alerts(control(s, d).where(f"t >= {CUT}"), ["status"])
_PERF = BASELINES + ", pf as (select t, sum(abs(mean_3 - y)) / sum(y) as wape, sum(mean_3 - y) / sum(y) as bias from baselines where y is not null group by t)"


def perf(s, d):
    by = base(s, d).where("y is not null").groupBy("t").agg((F.sum(F.abs(F.col("mean_3") - F.col("y"))) / F.sum("y")).alias("wape"), (F.sum(F.col("mean_3") - F.col("y")) / F.sum("y")).alias("bias"))
    return by.crossJoin(F.broadcast(by.where(f"t < {CUT}").agg(F.avg("wape").alias("ref"))))


QUERIES["drf10_naive_rules"] = lambda s, d: R.naive_rules(perf(s, d))
ORACLE["drf10_naive_rules"] = f"""with {_PERF}, x as (select *, (select avg(wape) from pf where t < {CUT}) as ref, case when abs(100 * bias) > 20 then 'alert' when abs(100 * bias) > 10 then 'warn' else 'ok' end as b from pf)
  select t, case when wape > 1.5 * ref then 'alert' when wape > 1.2 * ref then 'warn' else 'ok' end as wape_status, case when b <> 'ok' and coalesce(lag(b) over (order by t) <> 'ok', false) then 'alert' else b end as bias_status from x"""
QUERIES["drf12_data_quality"] = lambda s, d: _r(R.data_quality(items(s, d).where("partner <> '3' or t >= 23960"), F.col("t") < 23950), "change", "new_codes")
ORACLE["drf12_data_quality"] = f"""with {ITEMS}, it as (select * from items where partner <> '3' or t >= 23960), by_ as (select period, t, count(*) as rows, coalesce(100 * sum(case when product not in (select product from it where t < 23950) or partner not in (select partner from it where t < 23950) then item_value{D} end)::double / sum(item_value{D})::double, 0.0) as new_codes from it group by 1, 2),
  c as (select a.period, a.rows, 100 * (a.rows / b.rows - 1) as change, a.new_codes from by_ a left join by_ b on b.t = a.t - 12)
  select period, rows, round(change, 6) as change, round(new_codes, 6) as new_codes, case when new_codes > 1 or coalesce(abs(change) > 50, false) then 'alert' when abs(change) > 25 then 'warn' else 'ok' end as status from c"""

# experiments: units are series-months, clusters are products
_UNITS = BASELINES + ", units as (select product, partner, t, (y > naive)::int::double as y, ln(1 + naive) as x, ln(1 + mean_3) as score, case (t + len(partner)) % 3 when 0 then 'C' when 1 then 'A' else 'B' end as arm from baselines where y is not null)"


def units(s, d):
    arm = F.element_at(F.array(F.lit("C"), F.lit("A"), F.lit("B")), (F.col("t") + F.length("partner")) % 3 + 1)
    return base(s, d).where("y is not null").select("product", "partner", "t", (F.col("y") > F.col("naive")).cast("double").alias("y"), F.log1p("naive").alias("x"), F.log1p("mean_3").alias("score"), arm.alias("arm"))


QUERIES["exp02_icc_deff"] = lambda s, d: _r(X.icc(units(s, d), "y", "product"), "icc", "deff")
ORACLE["exp02_icc_deff"] = f"""with {_UNITS}, c as (select count(*) as n, sum(y) as s, sum(y * y) as q from units group by product), a as (select count(*)::double as k, sum(n)::double as nn, sum(n * n)::double as n2, sum(s) as s, sum(q) as q, sum(s * s / n) as b from c),
  m as (select *, (b - s * s / nn) / (k - 1) as msb, (q - b) / (nn - k) as msw, (nn - n2 / nn) / (k - 1) as m0 from a) select round((msb - msw) / (msb + (m0 - 1) * msw), 6) as icc, round(1 + (n2 / nn - 1) * (msb - msw) / (msb + (m0 - 1) * msw), 6) as deff from m"""
QUERIES["exp09_smd"] = lambda s, d: _r(X.smd(units(s, d), "C", ["x", "score"]), "smd")
ORACLE["exp09_smd"] = f"""with {_UNITS}, l as (select arm, "column", avg(v) as m, var_samp(v) as va from (select arm, x, score from units) unpivot (v for "column" in (x, score)) group by 1, 2) select a.arm, a."column", round((a.m - c.m) / sqrt((a.va + c.va) / 2), 6) as smd from l a join l c on c.arm = 'C' and a."column" = c."column" where a.arm <> 'C'"""
_CM = _UNITS + """, cl as (select arm, product, count(*) as n, sum(y) as s from units group by 1, 2), am as (select arm, count(*) as k, sum(n)::double as nn, sum(s) as ss from cl group by 1),
  mv as (select a.arm, any_value(ss / nn) as m, any_value(k / (k - 1)) * sum(power(s - ss / nn * n, 2)) / power(any_value(nn), 2) as v from cl join am a using (arm) group by 1)"""
QUERIES["exp13_cluster_means"] = lambda s, d: _r(X.cluster_means(units(s, d), "y", "product"), "m", "v", k=9)
ORACLE["exp13_cluster_means"] = f"with {_CM} select arm, round(m, 9) as m, round(v, 9) as v from mv"
QUERIES["exp14_compare"] = lambda s, d: _r(X.compare(units(s, d), "y", "product", "C").drop("p"), "control", "effect", "se", "z", k=5)
ORACLE["exp14_compare"] = f"with {_CM} select a.arm, round(c.m, 5) as control, round(a.m - c.m, 5) as effect, round(sqrt(a.v + c.v), 5) as se, round((a.m - c.m) / sqrt(a.v + c.v), 5) as z from mv a join mv c on c.arm = 'C' where a.arm <> 'C'"
QUERIES["exp14_holm"] = lambda s, d: _r(X.holm(X.compare(units(s, d), "y", "product", "C")), "control", "effect", "se", "z", "p", "p_holm")
QUERIES["exp15_holm"] = lambda s, d: _r(X.holm(items(s, d).groupBy(F.col("region").cast("string").alias("arm")).agg((F.count("*") % 1000 / 10000).alias("p"))), "p", "p_holm")
ORACLE["exp15_holm"] = f"with {ITEMS}, p as (select region::varchar as arm, (count(*) % 1000) / 10000 as p from items group by 1), q as (select *, least(1.0, ((select count(*) from p) - row_number() over (order by p, arm) + 1) * p) as x from p) select arm, round(p, 6) as p, round(max(x) over (order by p, arm), 6) as p_holm from q"
QUERIES["exp12_cuped"] = lambda s, d: _r(X.cuped(units(s, d), "y", ["x"]).groupBy("arm").agg(F.avg("y_adj").alias("m"), F.var_samp("y_adj").alias("v")), "m", "v")
ORACLE["exp12_cuped"] = f"with {_UNITS}, b as (select covar_samp(x, y) / var_samp(x) as b, avg(x) as mx from units) select arm, round(avg(y - b * (x - mx)), 6) as m, round(var_samp(y - b * (x - mx)), 6) as v from units, b group by arm"
QUERIES["exp08_srm"] = lambda s, d: _r(X.srm(units(s, d), ["C", "A", "B"], [1, 1, 1]), "chi2")
ORACLE["exp08_srm"] = f"with {_UNITS}, n as (select arm, count(*) as n from units group by 1) select round(sum(power(n - e, 2) / e), 6) as chi2, count(*) - 1 as df from (select n, sum(n) over () / 3 as e from n)"
QUERIES["exp07_assign"] = lambda s, d: X.assign(units(s, d).withColumn("c", F.concat_ws("_", "product", "partner")), ["C", "A", "B"], [2, 1, 1], "c", "score")
QUERIES["exp19_aa_tests"] = lambda s, d: X.aa_tests(units(s, d).withColumn("c", F.concat_ws("_", "product", "partner")), "c", "y", 1000, True).agg(F.avg((F.col("p") < 0.05).cast("double")).alias("false_positives"), F.count("*").alias("n"))
QUERIES["exp22_subgroups"] = lambda s, d: _r(units(s, d).crossJoin(F.broadcast(units(s, d).agg(F.percentile("score", F.lit(0.5)).alias("cut")))).groupBy("arm", (F.col("score") >= F.col("cut")).alias("high")).agg(F.avg("y").alias("m"), F.count("*").alias("n")), "m")
ORACLE["exp22_subgroups"] = f"with {_UNITS} select arm, score >= (select quantile_cont(score, 0.5) from units) as high, round(avg(y), 6) as m, count(*) as n from units group by 1, 2"
QUERIES["exp10_potential"] = lambda s, d: X.potential_outcomes(X.base_probability(units(s, d), "score", "y"), 0.2, ["product", "partner", "t"]).groupBy("arm").agg(F.round(F.avg("y"), 6).alias("y0"), F.round(F.avg("y1"), 6).alias("y1"))
QUERIES["exp01_opportunities"] = lambda s, d: X.opportunities(base(s, d).where("t = 23990").select("product", "partner", F.col("mean_3").alias("score")), panel(s, d).where("segment = 'bienes'"), 200, "1998", "1999")
ORACLE["exp01_opportunities"] = f"""with {BASELINES}, c as (select product, partner, mean_3 as score from baselines where t = 23990 order by mean_3 desc, product, partner limit 200)
  select c.product, c.partner, score, coalesce(sum(greatest(value, 0){D}) filter (period like '1998%'), 0)::double as value_a, coalesce(sum(greatest(value, 0){D}) filter (period like '1999%'), 0)::double as value_b, count(distinct period) filter (period like '1998%') as months_a
  from c left join (select * from panel where segment = 'bienes') p on p.product = c.product and p.partner = c.partner group by 1, 2, 3"""

# causal: partner 7 is treated from January 1999
_CAU = PANEL + f""", gp as (select product, partner, t, greatest(sum(value{D})::double, 0) as v from panel where segment = 'bienes' and not pseudo group by 1, 2, 3),
  bal as (select k.product, k.partner, m.t::int as t, coalesce(v, 0.0) as v, (m.t - {CUT})::int as rel from (select distinct product, partner from gp where t < {CUT} and v > 0) k cross join (select unnest(range((select min(t) from gp), (select max(t) from gp) + 1)) as t) m left join gp on gp.product = k.product and gp.partner = k.partner and gp.t = m.t),
  grp as (select product, case when product = 'Brand#1' then 'excluded' when n % 5 = 0 then 'exempt' when n % 5 = 1 then 'partly_exempt' else 'taxed' end as "group" from (select distinct product, substr(product, 7)::int as n from panel)),
  smp as (select b.*, g."group", b.partner = '7' as at_treated, rel >= 0 as post, b.partner = '7' and rel >= 0 and "group" = 'taxed' as treated, b.product || '_' || b.partner as pair, b.product || '_' || b.t as product_month from bal b join grp g using (product)
    where "group" in ('taxed', 'exempt') and t <= {CUT + 11} and product in (select product from bal where partner = '7'))"""


def balanced(s, d):
    return C.balanced(panel(s, d), CUT)


def groups(s, d):
    p = panel(s, d).select("product").distinct().withColumn("n", F.substring("product", 7, 9).cast("int"))
    return C.product_groups(p.select("product"), p.where("n % 5 < 2").select("product", (F.col("n") % 5 == 0).alias("complete")), ["Brand#1"])


def sample(s, d):
    return C.sample(balanced(s, d), groups(s, d), ["taxed", "exempt"], "7", CUT + 11)


QUERIES |= {
    "cau01_groups": groups,
    "cau02_balanced": balanced,
    "cau03_sample": sample,
    "cau14_sparsity": lambda s, d: C.sparsity(balanced(s, d)),
    "cau08_before_after": lambda s, d: _r(C.before_after(sample(s, d)), "treated_before", "treated_after", "rest_before", "rest_after", "ratio", k=4),
    "cau13_monthly_pivot": lambda s, d: C.monthly_pivot(panel(s, d), ["Brand#2", "Brand#3"], ["1", "7"]),
    "cau04_did": lambda s, d: C.did(sample(s, d)),
    "cau06_event_study": lambda s, d: C.event_study(sample(s, d)),
    "cau07_placebos": lambda s, d: C.placebos(sample(s, d), "7"),
    "cau12_block_bootstrap": lambda s, d: C.block_bootstrap(sample(s, d).where("at_treated").groupBy("t", "post").agg(F.sum("v").alias("v"))),
    "agg30_design": lambda s, d: sample(s, d).groupBy("group").agg(F.countDistinct("product").alias("products"), F.sum(F.when(F.col("at_treated"), F.col("v").cast("decimal(18,2)")).otherwise(0)).cast("double").alias("value")),
}
ORACLE |= {
    "cau01_groups": f"with {_CAU} select * from grp",
    "cau02_balanced": f"with {_CAU} select * from bal",
    "cau03_sample": f"with {_CAU} select * from smp",
    "cau14_sparsity": f"with {_CAU} select count(*) as rows, count(distinct product || '_' || partner) as pairs, round(100 * avg((v = 0)::int::double), 6) as zeros from bal",
    "cau08_before_after": f"with {_CAU}, a as (select at_treated, post, avg(v) as v from (select at_treated, post, t, sum(v{D})::double as v from smp group by 1, 2, 3) group by 1, 2), w as (select max(v) filter (at_treated and not post) as tb, max(v) filter (at_treated and post) as ta, max(v) filter (not at_treated and not post) as rb, max(v) filter (not at_treated and post) as ra from a) select round(tb, 4) as treated_before, round(ta, 4) as treated_after, round(rb, 4) as rest_before, round(ra, 4) as rest_after, round(ta / tb / (ra / rb), 4) as ratio from w",
    "cau13_monthly_pivot": f"with {_CAU} select m.t::int as t, coalesce(sum(v) filter (partner = '1'), 0.0) as to_1, coalesce(sum(v) filter (partner = '7'), 0.0) as to_7 from (select unnest(range((select min(t) from gp), (select max(t) from gp) + 1)) as t) m left join (select t, partner, sum(value{D})::double as v from panel where segment = 'bienes' and not pseudo and product in ('Brand#2', 'Brand#3') group by 1, 2) g on g.t = m.t group by 1",
    "agg30_design": f'with {_CAU} select "group", count(distinct product) as products, coalesce(sum(v{D}) filter (at_treated), 0)::double as value from smp group by 1',
}
QUERIES["spl03_chrono"] = lambda s, d: S.composition(S.chrono_split(activity(s, d).select("product", "partner", "t"), "t", [0.4, 0.2, 0.4]), "t")
ORACLE["spl03_chrono"] = f"with {BASELINES}, a as (select t, count(*) as n from baselines where active_12 between 1 and 9 and y is not null group by t), r as (select t, n, row_number() over (order by t) as r, count(*) over () as m from a) select t, case when r <= round_even(m * 0.4, 0) then 0 when r <= round_even(m * (0.4 + 0.2), 0) then 1 else 2 end::int as part, n, 100.0::double as share from r"
QUERIES["spl02_random"] = lambda s, d: S.sizes(S.random_split(activity(s, d).select("product", "partner", "t"), ["product", "partner", "t"], [0.5, 0.2, 0.3]), 3)
ORACLE["spl02_random"] = f"with {BASELINES}, n as (select count(*) as n from baselines where active_12 between 1 and 9 and y is not null) select part::int as part, (case part when 0 then round_even(n * 0.5, 0) when 1 then round_even(n * (0.5 + 0.2), 0) - round_even(n * 0.5, 0) else n - round_even(n * (0.5 + 0.2), 0) end)::bigint as n from n, (values (0), (1), (2)) p(part)"
