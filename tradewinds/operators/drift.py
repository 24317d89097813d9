"""Drift: distribution distances, price index, control charts and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewinds.operators.ranks import running


def level(v: Column, warn: float, alert: float) -> Column:
    """ok, warn or alert by strict thresholds of |v|; missing and NaN are ok."""
    a = F.abs(F.nanvl(v, F.lit(None).cast("double")))
    return F.when(a > alert, "alert").when(a > warn, "warn").otherwise("ok")


def psi(long: DataFrame, by: list[str], bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """Population stability index of `x` between the rows with cur = 0 and cur = 1.

    Bins are cut at the reference's quantiles, distinct ones, open at both ends, [a, b); nulls are a bin of their own; shares are of all rows and at least eps.
    A constant reference has no inner edge: the index is null.
    """
    edges = long.where("cur = 0").groupBy(*by).agg(F.array_distinct(F.percentile("x", F.array(*[F.lit(k / bins) for k in range(bins + 1)]))).alias("e"))
    inner = F.when(F.size("e") > 2, F.slice("e", F.lit(2), F.size("e") - 2)).otherwise(F.array().cast("array<double>"))
    last = F.element_at("e", -1)
    edges = edges.select(*by, inner.alias("inner"), last.alias("last"), (F.size("e") > 1).alias("usable"))
    b = F.when(F.col("x").isNull(), -1).otherwise(F.size(F.filter("inner", lambda c: c <= F.col("x"))))
    rows = long.join(edges, by) if by else long.crossJoin(F.broadcast(edges))
    n = rows.groupBy(*by, "usable", b.alias("bin")).agg(F.count_if(F.col("cur") == 0).alias("r"), F.count_if(F.col("cur") == 1).alias("c"))
    w = W.partitionBy(*by)
    share = lambda c: F.greatest(F.lit(eps), F.col(c) / F.sum(c).over(w))
    s = n.select(*by, "usable", share("r").alias("r"), share("c").alias("c"))
    value = F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r")))
    return s.groupBy(*by).agg(F.when(F.max("usable"), value).alias("psi"))


def psi_categorical(long: DataFrame, eps: float = 1e-4) -> DataFrame:
    """The index between weighted shares of categories: columns x, w, cur."""
    n = long.groupBy("x").agg(F.sum(F.when(F.col("cur") == 0, F.col("w")).otherwise(0.0)).alias("r"), F.sum(F.when(F.col("cur") == 1, F.col("w")).otherwise(0.0)).alias("c"))
    w = W.partitionBy()
    share = lambda c: F.greatest(F.lit(eps), F.col(c) / F.sum(c).over(w))
    s = n.select(share("r").alias("r"), share("c").alias("c"))
    return s.agg(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))).alias("psi"))


def ks(long: DataFrame, by: list[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of non-null x; counts by value first."""
    n = long.where("x is not null").groupBy(*by, "x").agg(F.count_if(F.col("cur") == 0).alias("r"), F.count_if(F.col("cur") == 1).alias("c"))
    sums = running(n, by, F.col("x"), {"upto_r": F.col("r"), "upto_c": F.col("c")})
    d = F.abs(F.try_divide("upto_r", "all_upto_r") - F.try_divide("upto_c", "all_upto_c"))
    return sums.select(*by, d.alias("d")).groupBy(*by).agg(F.max("d").alias("ks"))


def feature_drift(frame: DataFrame, features: list[str], cur: Column) -> DataFrame:
    """PSI and KS of all features in one job: features unpivoted, rows marked as reference or current."""
    long = frame.select(cur.cast("int").alias("cur"), *[F.col(f).cast("double").alias(f) for f in features]).unpivot("cur", features, "feature", "x")
    return psi(long, ["feature"]).join(ks(long, ["feature"]), "feature", "full")


def price_index(grid: DataFrame, ref: Column) -> DataFrame:
    """By month: the value-weighted mean of the log of unit values over their reference medians, as a percentage."""
    uv = F.when((F.col("q") > 0) & (F.col("v") > 0), F.col("v") / F.col("q"))
    g = grid.withColumn("uv", uv)
    med = g.where(ref).groupBy("product", "partner").agg(F.percentile("uv", F.lit(0.5)).alias("m"))
    x = F.log(F.col("uv") / F.col("m"))
    rows = g.join(med, ["product", "partner"]).where("uv is not null and m is not null")
    return rows.groupBy("t").agg((100 * (F.exp(F.sum(F.col("v") * x) / F.sum("v")) - 1)).alias("price"))


def control_status(series: DataFrame, ref: Column, value: str = "x") -> DataFrame:
    """z against the reference's mean and sample deviation; |z| > 3 alerts, > 2 warns, and a warning after one of the same sign alerts."""
    lim = series.where(ref).agg(F.avg(value).alias("mu"), F.stddev_samp(value).alias("sd"))
    w = W.orderBy("t")
    z = series.crossJoin(F.broadcast(lim)).withColumn("z", F.try_divide(F.col(value) - F.col("mu"), F.col("sd"))).withColumn("s", level(F.col("z"), 2, 3))
    again = (F.col("s") == "warn") & F.coalesce((F.lag("s").over(w) == "warn") & (F.signum(F.lag("z").over(w)) == F.signum("z")), F.lit(False))
    return z.select("t", value, "z", F.when(again, "alert").otherwise(F.col("s")).alias("status"))


def naive_rules(perf: DataFrame) -> DataFrame:
    """WAPE over its reference: 1.2 warns, 1.5 alerts. |bias| over 10 % warns, 20 % alerts, and two months in a row that are not ok alert; the first month has none before it."""
    ratio = F.when(F.col("wape") > 1.5 * F.col("ref"), "alert").when(F.col("wape") > 1.2 * F.col("ref"), "warn").otherwise("ok")
    s = perf.withColumn("wape_status", ratio).withColumn("_b", level(100 * F.col("bias"), 10, 20))
    twice = (F.col("_b") != "ok") & F.coalesce(F.lag("_b").over(W.orderBy("t")) != "ok", F.lit(False))
    return s.select("t", "wape_status", F.when(twice, "alert").otherwise(F.col("_b")).alias("bias_status"))


def monitor(pred: DataFrame, methods: list[str], ref: Column) -> DataFrame:
    """By method and month (t): WAPE, bias and their statuses against the method's own WAPE over the months that `ref` names."""
    long = pred.where("y is not null").withColumn("_ref", ref).unpivot(["t", "y", "_ref"], methods, "method", "f").where("f is not null")
    by = long.groupBy("method", "t").agg(F.first("_ref").alias("_ref"), F.sum(F.abs(F.col("f") - F.col("y"))).alias("e"), F.sum(F.col("f") - F.col("y")).alias("d"), F.sum("y").alias("s"), F.count("*").alias("n"))
    own = W.partitionBy("method")
    by = by.withColumns({"wape": F.try_divide("e", "s"), "bias": F.try_divide("d", "s"), "ref": F.try_divide(F.sum(F.when(F.col("_ref"), F.col("e"))).over(own), F.sum(F.when(F.col("_ref"), F.col("s"))).over(own))})
    ratio = F.when(F.col("wape") > 1.5 * F.col("ref"), "alert").when(F.col("wape") > 1.2 * F.col("ref"), "warn").otherwise("ok")
    s = by.withColumn("_b", level(100 * F.col("bias"), 10, 20))
    twice = (F.col("_b") != "ok") & F.coalesce(F.lag("_b").over(own.orderBy("t")) != "ok", F.lit(False))
    return s.select("method", "t", "n", "wape", "bias", "ref", ratio.alias("wape_status"), F.when(twice, "alert").otherwise(F.col("_b")).alias("bias_status"))


def scenarios(monitored: DataFrame) -> DataFrame:
    """By method: months, mean WAPE and bias, and how often each status was raised."""
    count = lambda c, v: F.count_if(F.col(c) == v).alias(f"{c.split('_')[0]}_{v}")
    return monitored.groupBy("method").agg(F.count("*").alias("months"), F.round(F.avg("wape"), 6).alias("wape"), F.round(F.avg("bias"), 6).alias("bias"), *[count(c, v) for c in ("wape_status", "bias_status") for v in ("warn", "alert")])


def count_alerts(status: DataFrame, columns: list[str]) -> DataFrame:
    long = status.unpivot("t", columns, "layer", "status")
    return long.groupBy("layer").agg(F.count_if(F.col("status") == "warn").alias("warn"), F.count_if(F.col("status") == "alert").alias("alert"))


def new_codes(items: DataFrame, ref: Column) -> DataFrame:
    """By month: the share of value with a product or partner never seen in the reference. Either one counts."""
    seen = lambda c: items.where(ref).select(c).distinct().withColumn(f"_{c}", F.lit(True))
    rows = items.join(seen("product"), "product", "left").join(seen("partner"), "partner", "left")
    new = F.col("_product").isNull() | F.col("_partner").isNull()
    v = F.col("item_value").cast("decimal(18,2)")
    return rows.groupBy("period", "t").agg(F.count("*").alias("rows"), F.coalesce(100 * F.try_divide(F.sum(F.when(new, v)).cast("double"), F.sum(v).cast("double")), F.lit(0.0)).alias("new_codes"))


def data_quality(items: DataFrame, ref: Column, log: DataFrame | None = None) -> DataFrame:
    """By month: rows, change on the same month a year before, share with new codes, and the gate. `log` adds repaired, discarded and non-convertible counts by t."""
    by = new_codes(items, ref)
    prev = by.select((F.col("t") + 12).alias("t"), F.col("rows").alias("before"))
    out = by.join(prev, "t", "left").withColumn("change", 100 * (F.col("rows") / F.col("before") - 1))
    bad = F.lit(False)
    if log is not None:
        out = out.join(log, "t", "left")
        bad = (F.coalesce("discarded", F.lit(0)) > 0) | (F.coalesce("coerced", F.lit(0)) > 0)
    status = F.when(bad | (F.col("new_codes") > 1) | (F.abs("change") > 50), "alert").when(F.abs("change") > 25, "warn").otherwise("ok")
    return out.select("period", "rows", "change", "new_codes", status.alias("status"))
