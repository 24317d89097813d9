"""Product relatedness from co-occurrence in firm-months, and operators on the graph."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewinds.operators.panel import UNKNOWN_PRODUCT, goods, total
from tradewinds.shared import materialise, release


def firm_products(items: DataFrame, min_value: float = 5000.0, segment: str | None = "bienes") -> DataFrame:
    """Products of firm-months with at least `min_value`; an id is a firm within its month only."""
    rows = items.where(F.col("segment") == segment) if segment else items
    rows = rows.where(F.col("product").isNotNull() & (F.col("product") != UNKNOWN_PRODUCT)).dropna(subset=["trader"])
    return rows.groupBy("period", "trader", "product").agg(total("item_value").alias("v")).where(F.col("v") >= min_value)


def proximity(fp: DataFrame, min_obs: int = 10, weighting: str = "newman") -> DataFrame:
    """Undirected edges p < q with phi = C / max(n_p, n_q), n in firm-months.

    C sums over the firm-months of both products 1 / (k - 1), k their number of products ("newman"), or 1 ("none"). Products below min_obs are left out before k is taken.
    """
    if weighting not in ("newman", "none"):
        raise ValueError(f"unknown weighting: {weighting}")
    n = fp.groupBy("product").agg(F.count("*").alias("n")).where(F.col("n") >= min_obs)
    kept = fp.join(n, "product").select("period", "trader", "product", "n").withColumn("k", F.count("*").over(W.partitionBy("period", "trader"))).where("k > 1")
    a = kept.select("period", "trader", F.col("product").alias("p"), F.col("n").alias("np"), "k")
    b = kept.select("period", "trader", F.col("product").alias("q"), F.col("n").alias("nq"))
    w = 1 / (F.col("k") - 1) if weighting == "newman" else F.lit(1.0)
    pairs = a.join(b, ["period", "trader"]).where("p < q")
    return pairs.groupBy("p", "q").agg((F.sum(w) / F.greatest(F.first("np"), F.first("nq"))).alias("phi")).where("phi > 0")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("q").alias("p"), F.col("p").alias("q"), "phi"))


def presence(panel: DataFrame, products: DataFrame, least: float) -> DataFrame:
    """Pairs of network products and partners whose goods reach `least`."""
    rows = goods(panel).join(products, "product", "left_semi")
    return rows.groupBy("product", "partner").agg(total("value").alias("v")).where(F.col("v") >= least).select("product", "partner")


def density(edges: DataFrame, present: DataFrame, products: DataFrame) -> DataFrame:
    """For every network product and partner: the phi-weighted share of the product's neighbours that the partner takes; 0 without neighbours."""
    e = both_ways(edges)
    strength = e.groupBy("p").agg(F.sum("phi").alias("s"))
    near = e.join(present.select(F.col("product").alias("q"), "partner"), "q").groupBy("p", "partner").agg(F.sum("phi").alias("d"))
    spine = products.select(F.col("product").alias("p")).join(present.select("partner").distinct())
    out = spine.join(strength, "p", "left").join(near, ["p", "partner"], "left")
    return out.select(F.col("p").alias("product"), "partner", F.coalesce(F.col("d") / F.col("s"), F.lit(0.0)).alias("density"))


def nodes(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("p").alias("product")).agg(F.count("*").alias("degree"), F.sum("phi").alias("strength"))


def graph_summary(edges: DataFrame) -> DataFrame:
    n = nodes(edges).agg(F.count("*").alias("n"), F.percentile("degree", F.lit(0.5)).alias("median_degree"))
    e = edges.agg(F.count("*").alias("e"), F.percentile("phi", F.lit(0.5)).alias("phi_median"), F.percentile("phi", F.lit(0.99)).alias("phi_p99"))
    return n.crossJoin(e).withColumn("density", F.try_divide(2 * F.col("e"), F.col("n") * (F.col("n") - 1)))


def participation(edges: DataFrame, community: DataFrame) -> DataFrame:
    """1 - sum over communities of the squared share of a product's strength; 0 for isolated products."""
    by = both_ways(edges).join(community.select(F.col("product").alias("q"), "community"), "q").groupBy("p", "community").agg(F.sum("phi").alias("k"))
    w = W.partitionBy("p")
    out = by.withColumn("s", F.col("k") / F.sum("k").over(w)).groupBy(F.col("p").alias("product")).agg((1 - F.sum(F.col("s") * F.col("s"))).alias("participation"))
    return community.select("product").join(out, "product", "left").na.fill(0.0, ["participation"])


def modularity(edges: DataFrame, community: DataFrame, resolution: float = 1.0) -> DataFrame:
    c = community.select("product", "community")
    e = both_ways(edges).join(c.withColumnsRenamed({"product": "p", "community": "cp"}), "p").join(c.withColumnsRenamed({"product": "q", "community": "cq"}), "q")
    by = e.groupBy("cp").agg(F.sum("phi").alias("d"), F.sum(F.when(F.col("cp") == F.col("cq"), F.col("phi")).otherwise(0.0)).alias("inside"))
    return by.withColumn("w", F.sum("d").over(W.partitionBy())).agg(F.sum(F.col("inside") / F.col("w") - resolution * F.pow(F.col("d") / F.col("w"), 2)).alias("modularity"), (F.sum("inside") / F.first("w")).alias("inside_share"))


def partition_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Adjusted Rand index and normalised mutual information of two partitions of the same products."""
    t = a.select("product", F.col("community").alias("a")).join(b.select("product", F.col("community").alias("b")), "product").groupBy("a", "b").agg(F.count("*").cast("double").alias("n"))
    c2 = lambda x: x * (x - 1) / 2
    n = F.col("n")
    wa, wb, w = W.partitionBy("a"), W.partitionBy("b"), W.partitionBy()
    t = t.select("a", "b", "n", F.sum("n").over(wa).alias("ra"), F.sum("n").over(wb).alias("rb"), F.sum("n").over(w).alias("whole"), F.row_number().over(wa.orderBy("b")).alias("fa"), F.row_number().over(wb.orderBy("a")).alias("fb"))
    one = lambda f, x: F.sum(F.when(F.col(f) == 1, x).otherwise(0.0))
    ent = lambda r: -(F.col(r) / F.col("whole")) * F.log(F.col(r) / F.col("whole"))
    s = t.agg(F.sum(c2(n)).alias("ij"), one("fa", c2(F.col("ra"))).alias("i"), one("fb", c2(F.col("rb"))).alias("j"), F.first(c2(F.col("whole"))).alias("all_"), F.sum(n / F.col("whole") * F.log(n * F.col("whole") / (F.col("ra") * F.col("rb")))).alias("mi"), one("fa", ent("ra")).alias("ha"), one("fb", ent("rb")).alias("hb"))
    expected = F.col("i") * F.col("j") / F.col("all_")
    return s.select(F.try_divide(F.col("ij") - expected, (F.col("i") + F.col("j")) / 2 - expected).alias("ari"), F.try_divide(2 * F.col("mi"), F.col("ha") + F.col("hb")).alias("nmi"))


def components(edges: DataFrame) -> DataFrame:
    """Smallest product reachable from each.

    A round gives each product the smallest label of its neighbours, then the label of its label, so a path of n products takes some log n rounds; each round is
    written to the shared folder, and rounds go on until no label changes.
    """
    e = materialise(both_ways(edges).select("p", "q").distinct())
    labels = materialise(e.select(F.col("p").alias("product")).distinct().withColumn("c", F.col("product")))
    while True:
        near = e.join(labels.withColumnRenamed("product", "q"), "q").groupBy("p").agg(F.min("c").alias("m"))
        hooked = materialise(labels.join(near, F.expr("product = p")).select("product", F.least("c", "m").alias("c"), F.col("c").alias("was")))
        up = hooked.select(F.col("product").alias("c"), F.col("c").alias("above"))
        new = materialise(hooked.join(up, "c").select("product", F.col("above").alias("c"), "was"))
        release(hooked)
        release(labels)
        if not new.where("c <> was").limit(1).count():
            release(e)
            return new.select("product", F.col("c").alias("component"))
        labels = new


def activation(panel: DataFrame, target: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """Candidates: network products and partners with some presence but not in this pair; density, ubiquity, diversity and log values; active if the target window reaches `least`."""
    products = nodes(edges).select("product")
    here = presence(panel, products, least)
    rows = density(edges, here, products).join(here, ["product", "partner"], "left_anti")
    vp = goods(panel).groupBy("product").agg(F.log1p(total("value")).alias("log_value_p"))
    vc = goods(panel).groupBy("partner").agg(F.log1p(total("value")).alias("log_value_c"))
    tv = goods(target).groupBy("product", "partner").agg(total("value").alias("target_value"))
    out = rows.join(here.groupBy("product").agg(F.count("*").alias("ubiquity")), "product", "left").join(here.groupBy("partner").agg(F.count("*").alias("diversity")), "partner", "left")
    out = out.join(vp, "product", "left").join(vc, "partner", "left").join(tv, ["product", "partner"], "left").na.fill(0, ["ubiquity", "diversity"]).na.fill(0.0, ["log_value_p", "log_value_c", "target_value"])
    return out.withColumn("active", (F.col("target_value") >= least).cast("int"))


def louvain_of(rows: list[tuple[str, str, float]], resolution: float, seed: int) -> dict[str, int]:
    """Greedy modularity: nodes move to the neighbouring community of largest gain, communities are merged to nodes, until nothing moves. Ids by size."""
    names = sorted({x for p, q, _ in rows for x in (p, q)})
    member = {x: i for i, x in enumerate(names)}
    adj: list[dict[int, float]] = [{} for _ in names]
    for p, q, w in rows:
        a, b = member[p], member[q]
        adj[a][b] = adj[a].get(b, 0.0) + w
        adj[b][a] = adj[b].get(a, 0.0) + w
    rng = random.Random(seed)
    while True:
        strength = [sum(x.values()) for x in adj]
        whole = sum(strength) or 1.0
        com, weight = list(range(len(adj))), strength[:]
        moved, any_move = True, False
        order = list(range(len(adj)))
        rng.shuffle(order)
        while moved:
            moved = False
            for i in order:
                own = com[i]
                links: dict[int, float] = {}
                for j, w in adj[i].items():
                    if j != i:
                        links[com[j]] = links.get(com[j], 0.0) + w
                weight[own] -= strength[i]
                gain = lambda c: links.get(c, 0.0) - resolution * strength[i] * weight[c] / whole  # noqa: E731, B023
                best = max(sorted(links), key=gain, default=own)
                if gain(best) <= gain(own) + 1e-12:
                    best = own
                weight[best] += strength[i]
                if best != own:
                    com[i], moved, any_move = best, True, True
        ids = {c: k for k, c in enumerate(sorted(set(com)))}
        member = {x: ids[com[i]] for x, i in member.items()}
        if not any_move:
            break
        merged: list[dict[int, float]] = [{} for _ in ids]
        for i, links in enumerate(adj):
            for j, w in links.items():
                a, b = ids[com[i]], ids[com[j]]
                merged[a][b] = merged[a].get(b, 0.0) + w
        adj = merged
    sizes: dict[int, int] = {}
    for c in member.values():
        sizes[c] = sizes.get(c, 0) + 1
    first = {c: min(x for x, k in member.items() if k == c) for c in sizes}
    rank = {c: k for k, c in enumerate(sorted(sizes, key=lambda c: (-sizes[c], first[c])))}
    return {x: rank[c] for x, c in member.items()}


def communities(edges: DataFrame, resolution: float = 1.0, seed: int = 42) -> DataFrame:
    """Communities of the product graph. The graph is of products, thousands at most whatever the number of items, so it is one group of one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = louvain_of(list(zip(pdf["p"], pdf["q"], pdf["phi"])), resolution, seed)
        return pd.DataFrame({"product": list(found), "community": list(found.values())})

    return edges.select("p", "q", "phi").groupBy().applyInPandas(run, "product string, community int")


def backbone(edges: DataFrame, quantile: float = 0.995) -> DataFrame:
    """The maximum spanning forest, and the edges at or above a quantile of phi."""
    cut = edges.agg(F.percentile("phi", F.lit(quantile)).alias("cut"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        up: dict[str, str] = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        keep = []
        for p, q, phi in pdf.sort_values(["phi", "p", "q"], ascending=[False, True, True]).itertuples(index=False):
            a, b = root(p), root(q)
            if a != b:
                up[a] = b
                keep.append((p, q, phi))
        return pd.DataFrame(keep, columns=["p", "q", "phi"])

    tree = edges.select("p", "q", "phi").groupBy().applyInPandas(run, "p string, q string, phi double")
    strong = edges.join(F.broadcast(cut)).where("phi >= cut").select("p", "q", "phi")
    return tree.unionByName(strong).dropDuplicates(["p", "q"])


def community_summary(panel: DataFrame, community: DataFrame, market: str) -> DataFrame:
    """Size, share of value, three main products, distinct chapters, the main chapter's share, the share sold to one market and the main destination of each community."""
    rows = goods(panel).join(community.select("product", "community"), "product")
    ranked = lambda key: rows.groupBy("community", key).agg(total("value").alias("v")).withColumn("r", F.row_number().over(W.partitionBy("community").orderBy(F.desc("v"), key))).withColumn("s", F.col("v") / F.sum("v").over(W.partitionBy("community")))
    top = ranked("product").where("r <= 3").groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "product"))), lambda x: x["product"]), ",").alias("top_products"))
    chapters = ranked("chapter").groupBy("community").agg(F.count("*").alias("chapters"), F.max("s").alias("main_chapter_share"))
    places = ranked("partner").groupBy("community").agg(F.max(F.when(F.col("r") == 1, F.col("partner"))).alias("main_partner"), F.coalesce(F.sum(F.when(F.col("partner") == market, F.col("s"))), F.lit(0.0)).alias("market_share"))
    size = rows.groupBy("community").agg(F.countDistinct("product").alias("products"), total("value").alias("value")).withColumn("value_share", F.col("value") / F.sum("value").over(W.partitionBy()))
    return size.join(top, "community").join(chapters, "community").join(places, "community")


def coverage(panel: DataFrame, products: DataFrame) -> DataFrame:
    """Percentage of goods value in products of the network."""
    rows = goods(panel).join(products.select("product").distinct().withColumn("_in", F.lit(True)), "product", "left")
    return rows.agg((100 * F.try_divide(total(F.when(F.col("_in"), F.col("value"))), total("value"))).alias("coverage"))


def stability(edges: DataFrame, resolutions: list[float], seeds: list[int]) -> DataFrame:
    """Communities, modularity and agreement with the first run, over resolutions and seeds. The collected graph is one of products."""
    edges = materialise(edges)
    base = materialise(communities(edges, resolutions[0], seeds[0]))
    out = None
    for g in resolutions:
        for s in seeds:
            c = communities(edges, g, s)
            row = c.agg((F.max("community") + 1).alias("communities")).crossJoin(modularity(edges, c, g)).crossJoin(partition_agreement(base, c)).select(F.lit(g).alias("resolution"), F.lit(s).alias("seed"), "communities", "modularity", "ari", "nmi")
            out = row if out is None else out.unionByName(row)
    return out
