"""Difference in differences on balanced panels of product-partner pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewinds.operators.panel import goods, total


def product_groups(products: DataFrame, annex: DataFrame, excluded: list[str]) -> DataFrame:
    """excluded over exempt (wholly) over partly exempt (in the annex) over taxed. annex: product, complete."""
    rows = products.join(annex.select("product", "complete"), "product", "left")
    group = F.when(F.col("product").isin(excluded), "excluded").when(F.col("complete"), "exempt").when(F.col("complete").isNotNull(), "partly_exempt").otherwise("taxed")
    return rows.select("product", group.alias("group"))


def balanced(panel: DataFrame, treatment: int) -> DataFrame:
    """Pairs with value before the treatment month, at every month of the panel; missing months are 0."""
    cells = goods(panel).groupBy("product", "partner", "t").agg(F.greatest(total("value"), F.lit(0.0)).alias("v"))
    pairs = cells.where((F.col("t") < treatment) & (F.col("v") > 0)).select("product", "partner").distinct()
    span = cells.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    spine = pairs.crossJoin(F.broadcast(span)).select("product", "partner", F.explode(F.sequence("a", "b")).alias("t"))  # one row
    return spine.join(cells, ["product", "partner", "t"], "left").select("product", "partner", "t", F.coalesce("v", F.lit(0.0)).alias("v"), (F.col("t") - treatment).alias("rel"))


def sample(rows: DataFrame, groups: DataFrame, kept: list[str], treated: str, end: int) -> DataFrame:
    """Months up to `end`, products of the groups that are sold to the treated partner at all, flags and fixed-effect keys."""
    sold = rows.where(F.col("partner") == treated).select("product").distinct()
    out = rows.where(F.col("t") <= end).join(groups.where(F.col("group").isin(kept)), "product").join(sold, "product", "left_semi")
    here, post = F.col("partner") == treated, F.col("rel") >= 0
    return out.select("*", here.alias("at_treated"), post.alias("post"), (here & post & (F.col("group") == "taxed")).alias("treated"), F.concat_ws("_", "product", "partner").alias("pair"), F.concat_ws("_", "product", "t").alias("product_month"))


def sparsity(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.countDistinct("product", "partner").alias("pairs"), F.round(100 * F.avg((F.col("v") == 0).cast("double")), 6).alias("zeros"))


def before_after(rows: DataFrame) -> DataFrame:
    """Mean monthly value before and after, of the treated partner and the rest, and the ratio of ratios."""
    by = rows.groupBy("at_treated", "post", "t").agg(F.sum(F.col("v").cast("decimal(18,2)")).cast("double").alias("v")).groupBy("at_treated", "post").agg(F.avg("v").alias("v"))
    one = lambda a, p: F.max(F.when((F.col("at_treated") == a) & (F.col("post") == p), F.col("v")))
    w = by.agg(one(True, False).alias("treated_before"), one(True, True).alias("treated_after"), one(False, False).alias("rest_before"), one(False, True).alias("rest_after"))
    return w.withColumn("ratio", F.try_divide(F.try_divide("treated_after", "treated_before"), F.try_divide("rest_after", "rest_before")))


def monthly_pivot(panel: DataFrame, products: list[str], partners: list[str]) -> DataFrame:
    """Month by partner values of some products on an axis without gaps."""
    rows = goods(panel)
    span = rows.agg(F.min("t").alias("a"), F.max("t").alias("b")).select(F.explode(F.sequence("a", "b")).alias("t"))
    wide = rows.where(F.col("product").isin(products)).groupBy("t").pivot("partner", partners).agg(total("value"))
    return span.join(wide, "t", "left").na.fill(0.0).withColumnsRenamed({p: f"to_{p}" for p in partners})


def monthly_unit_values(panel: DataFrame, products: list[str], partners: list[str]) -> DataFrame:
    """Month by partner on an axis without gaps: value, quantity (0 where none) and unit value (null where nothing was weighed) of some products."""
    rows = goods(panel)
    span = rows.agg(F.min("t").alias("a"), F.max("t").alias("b")).select(F.explode(F.sequence("a", "b")).alias("t"))
    wide = rows.where(F.col("product").isin(products)).groupBy("t").pivot("partner", partners).agg(total("value").alias("value"), total("quantity").alias("quantity"))
    of = lambda p, c: F.coalesce(F.col(f"{p}_{c}"), F.lit(0.0))
    columns = [x for p in partners for x in (of(p, "value").alias(f"value_{p}"), of(p, "quantity").alias(f"quantity_{p}"), F.when(of(p, "quantity") > 0, of(p, "value") / of(p, "quantity")).alias(f"unit_{p}"))]
    return span.join(wide, "t", "left").select("t", *columns)


def pairs_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows each of two tables of pairs has that the other lacks; both 0 if they are equal."""
    return a.exceptAll(b).agg(F.count("*").alias("only_first")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_second")))


def block_bootstrap(series: DataFrame, block: int = 3, draws: int = 5000, seed: int = 42) -> DataFrame:
    """Difference of means after and before (columns t, v, post) with a moving-block percentile interval. A hundred-odd months: draws are rows, blocks are sums taken once."""
    n = series.groupBy("post").agg(F.count("*").alias("n"))
    w = W.partitionBy("post").orderBy("t")
    ranked = series.withColumn("r", F.row_number().over(w) - 1).join(n, "post")
    starts = ranked.withColumn("s", F.sum("v").over(w.rowsBetween(0, block - 1))).where(F.col("r") <= F.col("n") - block).select("post", F.col("r").alias("start"), "s", "n")
    picks = n.where(F.col("n") >= block).select("post", "n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).select("*", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / block).cast("int"))).alias("k"))
    picks = picks.withColumn("start", F.pmod(F.xxhash64("post", "draw", "k", F.lit(seed)), F.col("n") - block + 1).cast("int"))
    means = picks.drop("n").join(F.broadcast(starts), ["post", "start"]).groupBy("draw", "post").agg((F.sum("s") / (F.count("*") * block)).alias("m"))
    d = means.groupBy("draw").agg(F.sum(F.when(F.col("post"), F.col("m")).otherwise(-F.col("m"))).alias("d"))
    point = series.agg((F.avg(F.when(F.col("post"), F.col("v"))) - F.avg(F.when(~F.col("post"), F.col("v")))).alias("difference"))
    return point.crossJoin(d.agg(F.percentile("d", F.lit(0.025)).alias("lo"), F.percentile("d", F.lit(0.975)).alias("hi")))


def _profile(y: np.ndarray, d: np.ndarray, beta: np.ndarray, rounds: int = 500):
    """Score and information of beta for one product, its partner and month effects profiled out.

    y: partners by months. d: regressors by partners by months. Partners and months without trade say nothing and go.
    """
    y, d = y[y.sum(1) > 0], d[:, y.sum(1) > 0]
    keep = y.sum(0) > 0
    y, d = y[:, keep], d[:, :, keep]
    k = len(beta)
    if y.size == 0 or min(y.shape) < 2:
        return np.zeros(k), np.zeros((k, k))
    base = np.exp(np.clip(np.tensordot(beta, d, 1), -30, 30))
    a, b = y.sum(1) / base.sum(1), np.ones(y.shape[1])
    for _ in range(rounds):
        b = y.sum(0) / np.maximum(a @ base, 1e-300)
        new = y.sum(1) / np.maximum(base @ b, 1e-300)
        if np.abs(np.log(np.maximum(new, 1e-300) / np.maximum(a, 1e-300))).max() < 1e-10:
            a = new
            break
        a = new
    mu = a[:, None] * base * b[None, :]
    res = []
    for j in range(k):  # demean by both effects, weights mu
        x = d[j].astype(float)
        for _ in range(200):
            r = (mu * x).sum(1) / np.maximum(mu.sum(1), 1e-300)
            x = x - r[:, None]
            c = (mu * x).sum(0) / np.maximum(mu.sum(0), 1e-300)
            x = x - c[None, :]
            if max(np.abs(r).max(), np.abs(c).max()) < 1e-9:
                break
        res.append(x)
    x = np.array(res)
    return (x * (y - mu)).sum((1, 2)), np.einsum("iab,jab->ij", x * mu, x)


def ppml(rows: DataFrame, regressors: list[str], outcome: str = "v", steps: int = 25, tolerance: float = 1e-8) -> dict:
    """Poisson pseudo-likelihood with pair and product-month effects, clustered by product.

    Both effects lie within a product, so each product profiles its own block in its own task and returns a score, an information matrix and the outer product of
    its score; the driver takes Newton steps on their sums (as many numbers as regressors squared). Clustered variance sums the outer products, times k / (k - 1).
    """
    k = len(regressors)
    data = rows.select("product", "partner", "t", F.col(outcome).cast("double").alias("y"), *[F.col(r).cast("double").alias(f"x{j}") for j, r in enumerate(regressors)]).cache()

    def block(beta):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            y, (a, b) = _cells(pdf)
            d = np.full((k, *y.shape), -np.inf)
            for j in range(k):
                np.maximum.at(d[j], (a, b), pdf[f"x{j}"].to_numpy())
            s, h = _profile(y, np.where(np.isfinite(d), d, 0.0), beta)
            return pd.DataFrame({"x": [[*s, *h.ravel(), *np.outer(s, s).ravel(), float((s != 0).any())]]})

        return run

    beta = np.zeros(k)
    for _ in range(steps):
        sums = _sums(data.groupBy("product").applyInPandas(block(beta), "x array<double>"), k + 2 * k * k + 1)
        s, h = sums[:k], sums[k : k + k * k].reshape(k, k)
        step = np.linalg.lstsq(h, s, rcond=None)[0]
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < tolerance:
            break
    meat = sums[k + k * k : -1].reshape(k, k)
    inv = np.linalg.pinv(h)
    n = max(2, int(sums[-1]))
    v = inv @ meat @ inv * n / (n - 1)
    data.unpersist()
    return {"beta": beta, "var": v, "clusters": int(sums[-1])}


def _cells(pdf: pd.DataFrame) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """y by partner and month, and the place of each row in it."""
    partners, a = np.unique(pdf["partner"].to_numpy(), return_inverse=True)
    months, b = np.unique(pdf["t"].to_numpy(), return_inverse=True)
    y = np.zeros((len(partners), len(months)))
    np.add.at(y, (a, b), pdf["y"].to_numpy())
    return y, (a, b)


def _sums(parts: DataFrame, n: int) -> np.ndarray:
    """Sums of the places of arrays x of n numbers: rows of a place, so that many regressors are not many columns."""
    out = np.zeros(n)
    for r in parts.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.sum("v").alias("v")).collect():
        out[r["j"]] = r["v"]
    return out


def effect(beta: float) -> float:
    return math.expm1(beta)


def did(rows: DataFrame) -> DataFrame:
    f = ppml(rows, ["treated"])
    b, se = float(f["beta"][0]), float(np.sqrt(max(0.0, f["var"][0, 0])))
    p = math.erfc(abs(b / se) / math.sqrt(2)) if se else None
    return rows.sparkSession.createDataFrame([(b, se, effect(b), effect(b - 1.96 * se), effect(b + 1.96 * se), p, 2.8 * se, f["clusters"])], "beta double, se double, effect double, lo double, hi double, p double, mde double, clusters long")


def joint_wald(beta: np.ndarray, var: np.ndarray) -> tuple[float, int]:
    """Wald statistic that all of `beta` are 0, and its degrees of freedom: the rank of `var`, which is below the number of clusters."""
    values, vectors = np.linalg.eigh((var + var.T) / 2)
    keep = values > 1e-9 * max(float(values.max()), 1e-300)
    return float(((vectors[:, keep].T @ beta) ** 2 / values[keep]).sum()), int(keep.sum())


def event_study(rows: DataFrame, reference: int = -1) -> DataFrame:
    """One coefficient a month against the reference month (0 there), and the joint Wald statistic of the months before with its degrees of freedom.

    Months without treated trade have no finite coefficient and are left out with their rows of treated pairs.
    """
    taxed = F.col("at_treated") & (F.col("group") == "taxed")
    months = [r["rel"] for r in rows.where(taxed & (F.col("v") > 0)).select("rel").distinct().orderBy("rel").collect() if r["rel"] != reference]  # months of the window
    rows = rows.where(~taxed | F.col("rel").isin(*months, reference))
    wide = rows.withColumns({f"m{j}": taxed & (F.col("rel") == m) for j, m in enumerate(months)})
    f = ppml(wide, [f"m{j}" for j in range(len(months))])
    pre = [j for j, m in enumerate(months) if m < reference]
    wald, df = joint_wald(f["beta"][pre], f["var"][np.ix_(pre, pre)]) if pre else (None, 0)
    out = [(int(m), float(f["beta"][j]), float(np.sqrt(max(0.0, f["var"][j, j]))), wald, df) for j, m in enumerate(months)] + [(reference, 0.0, 0.0, wald, df)]
    return rows.sparkSession.createDataFrame(out, "rel int, beta double, se double, wald_pre double, df_pre int")


def placebos(rows: DataFrame, treated: str, n: int = 30) -> DataFrame:
    """The same estimate for the n partners with most value before the treatment, the treated one taken out; p by permutation against the real estimate."""
    top = [r["partner"] for r in rows.where((F.col("partner") != treated) & (F.col("rel") < 0)).groupBy("partner").agg(total("v").alias("v")).orderBy(F.desc("v"), "partner").limit(n).collect()]
    rest = rows.where((F.col("partner") != treated) & (F.col("group") == "taxed")).select("product", "partner", "t", F.col("v").cast("double").alias("y"), (F.col("rel") >= 0).alias("post"))  # others have no regressor
    return rows.sparkSession.createDataFrame(list(zip(top, map(float, _ppml_each(rest, top)))), "partner string, beta double")


def _ppml_each(rows: DataFrame, partners: list[str], steps: int = 25, tolerance: float = 1e-8) -> np.ndarray:
    """For each partner the `ppml` coefficient of its months with `post`: separate fits whose Newton steps share one pass over the products."""
    data, k = rows.cache(), len(partners)

    def block(beta, open_):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            y, (a, b) = _cells(pdf)
            names, post = pdf["partner"].to_numpy(), pdf["post"].to_numpy()
            out = np.zeros(2 * k)
            for j in np.flatnonzero(open_):
                d = np.zeros((1, *y.shape))
                d[0, a, b] = (names == partners[j]) & post
                if d.any():  # else no information
                    s, h = _profile(y, d, beta[j : j + 1])
                    out[j], out[k + j] = s[0], h[0, 0]
            return pd.DataFrame({"x": [out.tolist()]})

        return run

    beta, open_ = np.zeros(k), np.ones(k, bool)
    for _ in range(steps):
        sums = _sums(data.groupBy("product").applyInPandas(block(beta, open_), "x array<double>"), 2 * k)
        step = np.where(open_ & (sums[k:] > 0), sums[:k] / np.where(sums[k:] > 0, sums[k:], 1.0), 0.0)
        beta = beta + np.clip(step, -2, 2)
        open_ &= np.abs(step) >= tolerance
        if not open_.any():
            break
    data.unpersist()
    return beta


def permutation_p(placebo: DataFrame, beta: float) -> DataFrame:
    n = F.count("*")
    return placebo.agg(((F.count_if(F.abs("beta") >= abs(beta)) + 1) / (n + 1)).alias("two_sided"), ((F.count_if(F.col("beta") <= beta) + 1) / (n + 1)).alias("one_sided"))


def annex_codes(text: DataFrame) -> DataFrame:
    """Eight-digit codes at the start of lines of `text`; by product the number of codes and whether one ends in 00."""
    codes = text.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*(\d{8})\b"), F.lit(1))).alias("code")).distinct()
    return codes.groupBy(F.substring("code", 1, 6).alias("product")).agg(F.count("*").alias("n_codes"), F.bool_or(F.col("code").endswith("00")).alias("complete"))


def weighted_mean(x: Column, w: Column) -> Column:
    return F.try_divide(F.sum(x * w), F.sum(w))
