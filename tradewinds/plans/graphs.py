"""Queries over the product graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewinds.operators import graph as G
from tradewinds.plans.base import ITEMS, PANEL, items, panel

QUERIES, ORACLE = {}, {}
D = "::decimal(18,2)"
LEAST, OBS, PRESENT = 30000.0, 10, 500000.0

EDGES = f"""fp as (select period, trader, product from items where segment = 'bienes' and trader is not null and product is not null group by period, trader, product having coalesce(sum(item_value{D}), 0) >= {LEAST}),
np as (select product, count(*) as n from fp group by product having count(*) >= {OBS}),
kept as (select * from (select fp.*, n, count(*) over (partition by period, trader) as k from fp join np using (product)) where k > 1),
edges as (select a.product as p, b.product as q, sum(1.0::double / (a.k - 1)) / greatest(any_value(a.n), any_value(b.n)) as phi from kept a join kept b on a.period = b.period and a.trader = b.trader and a.product < b.product group by 1, 2),
bw as (select p, q, phi from edges union all select q, p, phi from edges),
com as (select distinct p as product, (substr(p, -1)::int % 3)::int as community from bw)"""
FULL = PANEL + ", " + EDGES + f""", early as (select * from panel where segment = 'bienes' and not pseudo and period < '1999-01'), late as (select * from panel where segment = 'bienes' and not pseudo and period >= '1999-01'),
pres as (select product, partner from early where product in (select p from bw) group by 1, 2 having sum(value{D}) >= {PRESENT}),
dens as (select s.p as product, s.partner, coalesce(d / st, 0.0) as density from (select distinct p, partner from bw cross join (select distinct partner from pres)) s
  left join (select p, sum(phi) as st from bw group by p) a on a.p = s.p left join (select p, partner, sum(phi) as d from bw join pres on q = product group by 1, 2) b on b.p = s.p and b.partner = s.partner)"""


def edges(s, d, weighting="newman"):
    return G.proximity(G.firm_products(items(s, d), LEAST), OBS, weighting)


def fixed(e):
    """A given partition, by the product's last digit."""
    return G.nodes(e).select("product", (F.substring("product", -1, 1).cast("int") % 3).alias("community"))


def _early(s, d):
    return panel(s, d).where("period < '1999-01'")


def _presence(s, d):
    return G.presence(_early(s, d), G.nodes(edges(s, d)).select("product"), PRESENT)


def _density(s, d):
    e = edges(s, d)
    return G.density(e, _presence(s, d), G.nodes(e).select("product")).withColumn("density", F.round("density", 6))


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


W = f"with {ITEMS}, {EDGES} "
QUERIES |= {
    "grf01_firm_products": lambda s, d: G.firm_products(items(s, d), LEAST).select("period", "trader", "product"),
    "grf02_proximity": lambda s, d: _r(edges(s, d), "phi"),
    "grf02_unweighted": lambda s, d: _r(edges(s, d, "none"), "phi"),
    "grf03_strong_edges": lambda s, d: _r(edges(s, d).where("phi > 0.05"), "phi"),
    "grf04_presence": _presence,
    "grf05_density": _density,
    "grf09_participation": lambda s, d: _r(G.participation(edges(s, d), fixed(edges(s, d))), "participation"),
    "grf10_nodes": lambda s, d: _r(G.nodes(edges(s, d)), "strength"),
    "grf10_summary": lambda s, d: _r(G.graph_summary(edges(s, d)), "density", "phi_median", "phi_p99"),
    "grf10_components": lambda s, d: G.components(edges(s, d)),
    "grf11_modularity": lambda s, d: _r(G.modularity(edges(s, d), fixed(edges(s, d))), "modularity", "inside_share"),
    "grf12_agreement": lambda s, d: _r(G.partition_agreement(fixed(edges(s, d)), fixed(edges(s, d)).withColumn("community", F.length("product") % 2)), "ari", "nmi"),
    "grf07_communities": lambda s, d: G.communities(edges(s, d)),
    "grf08_backbone": lambda s, d: _r(G.backbone(edges(s, d)), "phi"),
    "grf15_activation": lambda s, d: _r(G.activation(_early(s, d), panel(s, d).where("period >= '1999-01'"), edges(s, d), PRESENT), "density", "log_value_p", "log_value_c"),
}
ORACLE |= {
    "grf01_firm_products": W + "select * from fp",
    "grf02_proximity": W + "select p, q, round(phi, 6) as phi from edges",
    "grf02_unweighted": W + "select a.product as p, b.product as q, round(count(*)::double / greatest(any_value(a.n), any_value(b.n)), 6) as phi from kept a join kept b on a.period = b.period and a.trader = b.trader and a.product < b.product group by 1, 2",
    "grf03_strong_edges": W + "select p, q, round(phi, 6) as phi from edges where phi > 0.05",
    "grf04_presence": f"with {FULL} select * from pres",
    "grf05_density": f"with {FULL} select product, partner, round(density, 6) as density from dens",
    "grf09_participation": W + "select p as product, round(1 - sum(s * s), 6) as participation from (select p, k / sum(k) over (partition by p) as s from (select p, community, sum(phi) as k from bw join com on q = product group by 1, 2)) group by p",
    "grf10_nodes": W + "select p as product, count(*) as degree, round(sum(phi), 6) as strength from bw group by p",
    "grf10_summary": W + "select n, median_degree, e, round(phi_median, 6) as phi_median, round(phi_p99, 6) as phi_p99, round(2 * e / (n * (n - 1)), 6) as density from (select count(*) as n, quantile_cont(c::double, 0.5) as median_degree from (select count(*) as c from bw group by p)), (select count(*) as e, quantile_cont(phi, 0.5) as phi_median, quantile_cont(phi, 0.99) as phi_p99 from edges)",
    "grf11_modularity": W + "select round(sum(i / w - power(d / w, 2)), 6) as modularity, round(sum(i) / any_value(w), 6) as inside_share from (select d, i, sum(d) over () as w from (select a.community, sum(phi) as d, sum(case when a.community = b.community then phi else 0 end) as i from bw join com a on p = a.product join com b on q = b.product group by 1))",
    "grf12_agreement": W + """, t as (select community as a, (length(product) % 2)::int as b, count(*)::double as n from com group by 1, 2), ra as (select sum(n) as n from t group by a), rb as (select sum(n) as n from t group by b), z as (select sum(n) as n from t),
  x as (select (select sum(n * (n - 1) / 2) from t) as ij, (select sum(n * (n - 1) / 2) from ra) as i, (select sum(n * (n - 1) / 2) from rb) as j, (select n * (n - 1) / 2 from z) as m, (select -sum(ra.n / z.n * ln(ra.n / z.n)) from ra, z) as ha, (select -sum(rb.n / z.n * ln(rb.n / z.n)) from rb, z) as hb,
  (select sum(t.n / z.n * ln(t.n * z.n / (u.n * v.n))) from t join (select a, sum(n) as n from t group by a) u using (a) join (select b, sum(n) as n from t group by b) v using (b), z) as mi)
  select round((ij - i * j / m) / ((i + j) / 2 - i * j / m), 6) as ari, round(2 * mi / (ha + hb), 6) as nmi from x""".replace(W + ",", W),
    "grf15_activation": f"""with {FULL} select d.product, d.partner, round(density, 6) as density, coalesce(u.n, 0) as ubiquity, coalesce(w.n, 0) as diversity, round(coalesce(ln(1 + vp.v), 0.0), 6) as log_value_p, round(coalesce(ln(1 + vc.v), 0.0), 6) as log_value_c,
  coalesce(tv.v, 0.0) as target_value, (coalesce(tv.v, 0.0) >= {PRESENT})::int as active from dens d anti join pres using (product, partner)
  left join (select product, count(*) as n from pres group by 1) u on u.product = d.product left join (select partner, count(*) as n from pres group by 1) w on w.partner = d.partner
  left join (select product, sum(value{D})::double as v from early group by 1) vp on vp.product = d.product left join (select partner, sum(value{D})::double as v from early group by 1) vc on vc.partner = d.partner
  left join (select product, partner, sum(value{D})::double as v from late group by 1, 2) tv on tv.product = d.product and tv.partner = d.partner""",
}
ORACLE["grf12_agreement"] = ORACLE["grf12_agreement"].replace("community from bw) , t as", "community from bw), t as")
