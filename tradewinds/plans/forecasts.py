"""Queries over the dense axis: features, baselines and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewinds.operators import features as X
from tradewinds.operators import metrics as M
from tradewinds.plans.base import PANEL, panel

QUERIES, ORACLE = {}, {}
D = "::decimal(18,2)"
#: A chapter of the test tables that counts as a commodity.
COMMODITY = "ECONOMY ANODIZED BRASS"

GRID = PANEL + f""", gp as (select * from panel where segment = 'bienes' and not pseudo and product <> '000000'),
cells as (select product, partner, t, greatest(sum(value{D})::double, 0) as v, greatest(sum(quantity{D})::double, 0) as q, sum(n_decl)::double as n_decl, sum(n_firms)::double as n_firms from gp group by 1, 2, 3),
grid as (
  select k.product, k.partner, (select min(chapter) from gp where gp.product = k.product) as chapter, m.t::int as t, (m.t - (select min(t) from gp))::int as i, coalesce(v, 0.0) as v, coalesce(q, 0.0) as q, coalesce(n_decl, 0.0) as n_decl, coalesce(n_firms, 0.0) as n_firms
  from (select distinct product, partner from gp) k cross join (select unnest(range((select min(t) from gp), (select max(t) from gp) + 1)) as t) m left join cells c on c.product = k.product and c.partner = k.partner and c.t = m.t
)"""
FEATURES = GRID + f""", b as (
  select *, ln(1 + v) as l, (v > 0)::int as "on", case when q > 0 and v > 0 then v / q end as uv, sum(v) over w3 as s3, avg(v) over w3 as a3, avg(v) over w12 as a12, avg(n_firms) over w3 as f3 from grid
  window w3 as (partition by product, partner order by t rows 2 preceding), w12 as (partition by product, partner order by t rows 11 preceding)
), c as (
  select *, lag(l, 1) over w as lag_1, lag(l, 2) over w as lag_2, lag(l, 3) over w as lag_3, lag(l, 4) over w as lag_4, lag(l, 5) over w as lag_5, lag(l, 11) over w as lag_seasonal, lag(l, 12) over w as lag_12,
    avg(l) over w3 as mean_log_3, avg(l) over w6 as mean_log_6, avg(l) over w12 as mean_log_12, ln(1 + a3) as log_mean_3, ln(1 + a12) as log_mean_12, stddev_pop(l) over w12 as sd_log_12,
    sum("on") over w3 as active_3, sum("on") over w6 as active_6, sum("on") over w12 as active_12, coalesce(t - max(case when "on" = 1 then t end) over w12, 12)::int as since_active,
    lag(s3, 12) over w as p3, quantile_cont(uv, 0.5) over w12 as um, lag("on", 1) over w as on_1, lag("on", 2) over w as on_2, lag("on", 11) over w as on_seasonal, lead(v, 1) over w as target
  from b window w as (partition by product, partner order by t), w3 as (partition by product, partner order by t rows 2 preceding), w6 as (partition by product, partner order by t rows 5 preceding), w12 as (partition by product, partner order by t rows 11 preceding)
), ct as (
  select chapter, t, case when i >= 12 then ln(1 + c) - ln(1 + lag(c, 12) over w) end as chapter_growth, case when i >= 1 then ln(1 + c) - ln(1 + avg(c) over (partition by chapter order by t rows between 3 preceding and 1 preceding)) end as chapter_momentum
  from (select chapter, t, i, sum(v{D})::double as c from grid group by 1, 2, 3) window w as (partition by chapter order by t)
), pr as (
  select partner, t, case when row_number() over (partition by t order by v desc, partner) <= 10 then partner else 'other' end as partner_group from
  (select partner, t, sum(sum(v{D})) over (partition by partner order by t) as v from grid group by partner, t)
), features as (
  select product, partner, c.chapter, c.t, i, v, l as lag_0, lag_1, lag_2, lag_3, lag_4, lag_5, lag_seasonal, lag_12, mean_log_3, mean_log_6, mean_log_12, log_mean_3, log_mean_12,
    l - log_mean_3 as rel_lag_0, lag_1 - log_mean_3 as rel_lag_1, lag_2 - log_mean_3 as rel_lag_2, lag_seasonal - log_mean_3 as rel_lag_seasonal, lag_12 - log_mean_3 as rel_lag_12, log_mean_12 - log_mean_3 as rel_log_mean_12,
    sd_log_12, active_3::bigint as active_3, active_6::bigint as active_6, active_12::bigint as active_12, since_active, lag_seasonal - mean_log_12 as seasonal_gap,
    case when i >= 14 then ln(1 + s3) - ln(1 + p3) end as growth_3m, case when uv is not null then ln(uv / um) end as price_gap, ln(1 + n_decl) as log_n_decl, ln(1 + f3) as log_n_firms_3,
    "on", on_1, on_2, on_seasonal, ((c.t + 1 - 1) % 12 + 1)::int as target_month, c.chapter in ('{COMMODITY}') as commodity, active_12 >= 10 as regular, active_12 between 1 and 9 as intermittent, target, chapter_growth, chapter_momentum, partner_group
  from c join ct using (chapter, t) join pr using (partner, t)
)"""
BASELINES = GRID + """, s as (select *, sum(v) over (partition by product, partner order by t rows 2 preceding) as s3 from grid),
base as (
  select product, partner, chapter, t, i, (sum((v > 0)::int) over w12)::bigint as active_12, lead(v, 1) over w as y, v as naive, lag(v, 11) over w as seasonal,
    lag(v, 11) over w * case when i >= 14 and lag(s3, 12) over w > 0 then least(5.0, greatest(0.2, s3 / lag(s3, 12) over w)) else 1.0 end as seasonal_trend, avg(v) over (partition by product, partner order by t rows 2 preceding) as mean_3
  from s window w as (partition by product, partner order by t), w12 as (partition by product, partner order by t rows 11 preceding)
), baselines as (select * from base where i >= 11)"""

_FLOATS = "v lag_0 lag_1 lag_2 lag_3 lag_4 lag_5 lag_seasonal lag_12 mean_log_3 mean_log_6 mean_log_12 log_mean_3 log_mean_12 rel_lag_0 rel_lag_1 rel_lag_2 rel_lag_seasonal rel_lag_12 rel_log_mean_12 sd_log_12 seasonal_gap growth_3m price_gap log_n_decl log_n_firms_3 target chapter_growth chapter_momentum".split()
_GROUPS = {
    "fea01_lags": "lag_0 lag_1 lag_2 lag_3 lag_4 lag_5 lag_seasonal lag_12",
    "fea04_means": "mean_log_3 mean_log_6 mean_log_12 log_mean_3 log_mean_12 sd_log_12",
    "fea06_relative": "rel_lag_0 rel_lag_1 rel_lag_2 rel_lag_seasonal rel_lag_12 rel_log_mean_12 seasonal_gap",
    "fea08_activity": "active_3 active_6 active_12 since_active on on_1 on_2 on_seasonal regular intermittent",
    "fea11_growth_price": "growth_3m price_gap log_n_decl log_n_firms_3",
    "fea15_context": "chapter_growth chapter_momentum partner_group target_month commodity target",
}


def grid(s, d):
    return X.grid(panel(s, d))


def frame(s, d, h=1):
    return X.features(grid(s, d), h, 10, (COMMODITY,))


def _group(name, columns):
    cols = columns.split()
    QUERIES[name] = lambda s, d: frame(s, d).select("product", "partner", "t", *[F.round(c, 5).alias(c) if c in _FLOATS else F.col(c) for c in cols])
    ORACLE[name] = f"with {FEATURES} select product, partner, t, " + ", ".join(f"round({c}, 5) as {c}" if c in _FLOATS else f'"{c}"' for c in cols) + " from features"


for _name, _cols in _GROUPS.items():
    _group(_name, _cols)

QUERIES["fea25_grid"] = grid
ORACLE["fea25_grid"] = f"with {GRID} select * from grid"
QUERIES["fea24_history"] = lambda s, d: frame(s, d).groupBy("t").agg(
    F.count_if("regular").alias("regular"), F.count_if("intermittent").alias("intermittent"), F.round(F.try_divide(F.sum(F.when(F.col("regular"), F.col("target"))), F.sum("target")), 6).alias("regular_share"), F.round(F.avg(F.when(F.col("intermittent"), (F.col("target") > 0).cast("double"))), 6).alias("intermittent_active"),
)
ORACLE["fea24_history"] = f"""with {FEATURES} select t, count(*) filter (regular) as regular, count(*) filter (intermittent) as intermittent, round(sum(target) filter (regular) / nullif(sum(target), 0), 6) as regular_share,
  round(avg((target > 0)::int::double) filter (intermittent), 6) as intermittent_active from features group by t"""

METHODS = ["naive", "seasonal", "seasonal_trend", "mean_3"]


def base(s, d):
    return X.baselines(grid(s, d))


QUERIES["mlm01_baselines"] = lambda s, d: base(s, d).select("product", "partner", "t", "y", "naive", "seasonal", F.round("seasonal_trend", 5).alias("seasonal_trend"), F.round("mean_3", 5).alias("mean_3"))
ORACLE["mlm01_baselines"] = f"with {BASELINES} select product, partner, t, y, naive, seasonal, round(seasonal_trend, 5) as seasonal_trend, round(mean_3, 5) as mean_3 from baselines"
_LONG = ", long as (select chapter, y, method, greatest(f, 0) as f from baselines unpivot (f for method in (naive, seasonal, seasonal_trend, mean_3)) where y is not null)"
_SCORE = f"round(sum(abs(f - y)) / nullif(sum(y{D})::double, 0), 6) as wape, round(avg(abs(ln(1 + f) - ln(1 + y))), 6) as mae_log, round(sum(f - y) / nullif(sum(y{D})::double, 0), 6) as bias, count(*) as n"
QUERIES["met01_score"] = lambda s, d: M.score(base(s, d), METHODS, [])
ORACLE["met01_score"] = f"with {BASELINES}{_LONG} select method, {_SCORE} from long group by method"
QUERIES["met09_by_chapter"] = lambda s, d: M.score(base(s, d), METHODS, ["chapter"])
ORACLE["met09_by_chapter"] = f"with {BASELINES}{_LONG} select chapter, method, {_SCORE} from long group by chapter, method"
QUERIES["met08_months_won"] = lambda s, d: M.months_won(base(s, d), "mean_3", "naive")
ORACLE["met08_months_won"] = f"with {BASELINES} select count(*) filter (a < b) as won, count(*) as months from (select sum(abs(mean_3 - y)) as a, sum(abs(naive - y)) as b from baselines where y is not null group by t)"
QUERIES["met07_bootstrap"] = lambda s, d: M.bootstrap_difference(base(s, d), ["product"], "mean_3", "naive")


def activity(s, d):
    """Intermittent series: is the next month active, and the frequency of the last twelve as its score."""
    return base(s, d).where("active_12 between 1 and 9 and y is not null").select("product", "partner", "t", (F.col("y") > 0).cast("int").alias("y"), (F.col("active_12") / 12).alias("p"), (F.col("naive") > 0).cast("int").alias("persistence"), F.coalesce((F.col("seasonal") > 0).cast("int"), F.lit(0)).alias("seasonal_persistence"))


_ACT = BASELINES + ", act as (select product, partner, t, (y > 0)::int as y, active_12 / 12 as p, (naive > 0)::int as persistence, coalesce((seasonal > 0)::int, 0) as seasonal_persistence from baselines where active_12 between 1 and 9 and y is not null)"
_CURVE = _ACT + ", sc as (select p, sum(y) as pos, count(*) as n from act group by p), cv as (select *, sum(pos) over (order by p desc) as tp, sum(n) over (order by p desc) as k, sum(pos) over () as pp, sum(n) over () as nn from sc)"
QUERIES["mlm10_activity_baselines"] = activity
ORACLE["mlm10_activity_baselines"] = f"with {_ACT} select * from act"
QUERIES["met02_classification"] = lambda s, d: M.classification(activity(s, d), "y", "p", [])
ORACLE["met02_classification"] = f"""with {_CURVE} select (select round(sum(pos / pp * tp / k), 6) from cv) as ap, (select round(sum(pos * (nn - pp - (k - tp)) + pos * (n - pos) / 2) / (max(pp) * (max(nn) - max(pp))), 6) from cv) as auc,
  round(avg((p - y) * (p - y)), 6) as brier, round(avg(-case when y = 1 then ln(least(1 - 1e-6, greatest(1e-6, p))) else ln(1 - least(1 - 1e-6, greatest(1e-6, p))) end), 6) as log_loss, round(avg(y), 6) as base_rate from act"""
QUERIES["met03_precision_recall"] = lambda s, d: M.precision_recall(activity(s, d), "y", "p")
ORACLE["met03_precision_recall"] = f"with {_CURVE} select round(p, 6) as threshold, round(tp / k, 6) as precision, round(tp / pp, 6) as recall from cv"
QUERIES["met05_thresholds"] = lambda s, d: M.threshold_table(activity(s, d), "y", "p", [0.2, 0.4, 0.6])
ORACLE["met05_thresholds"] = f"with {_ACT} select x::double as threshold, round(100 * avg((p >= x)::int::double), 6) as flagged, round(sum(y) filter (p >= x) / nullif(count(*) filter (p >= x), 0), 6) as precision, round(coalesce(sum(y) filter (p >= x), 0) / nullif(sum(y), 0), 6) as recall from act, (values (0.2::double), (0.4::double), (0.6::double)) l(x) group by x"
QUERIES["met04_calibration"] = lambda s, d: M.calibration(activity(s, d), "y", "p", 4)
ORACLE["met04_calibration"] = f"with {_ACT}, e as (select quantile_cont(p, [0.25, 0.5, 0.75]) as e from act) select len(list_filter(e, lambda x: x < p))::int as bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(y), 6) as mean_y from act, e group by 1"
QUERIES["met06_precision_at"] = lambda s, d: M.precision_at(activity(s, d), "y", "p", ["product", "partner", "t"], [100, 500, 1000])
ORACLE["met06_precision_at"] = f"with {_ACT}, r as (select *, row_number() over (order by p desc, product, partner, t) as r from act) select k::int as k, round(avg(y), 6) as precision, round(avg(y) / (select avg(y) from act), 6) as lift from r, (values (100), (500), (1000)) l(k) where r <= k group by k"
