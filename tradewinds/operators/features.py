"""The dense monthly axis and leak-free features: one windowed pass for every origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewinds.operators.panel import goods, total

KEYS = ("product", "partner")
FIRST_ORIGIN = 11


def grid(panel: DataFrame) -> DataFrame:
    """Every series (product, partner) of goods at every month from the first to the last of the filtered panel; no trade is 0, negatives are 0.

    A product's chapter is the smallest that the panel has for it.
    """
    rows = goods(panel)
    cells = rows.groupBy(*KEYS, "t").agg(F.greatest(total("value"), F.lit(0.0)).alias("v"), F.greatest(total("quantity"), F.lit(0.0)).alias("q"), F.sum("n_decl").alias("n_decl"), F.sum("n_firms").alias("n_firms"))
    span = rows.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    chapters = rows.groupBy("product").agg(F.min("chapter").alias("chapter"))
    spine = rows.select(*KEYS).distinct().join(F.broadcast(span)).select(*KEYS, F.explode(F.sequence("a", "b")).alias("t"), "a")  # one row
    dense = spine.join(cells, [*KEYS, "t"], "left").join(chapters, "product")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c)
    return dense.select(*KEYS, "chapter", "t", (F.col("t") - F.col("a")).alias("i"), zero("v"), zero("q"), zero("n_decl"), zero("n_firms"))


def series() -> W:
    return W.partitionBy(*KEYS).orderBy("t")


def last(n: int):
    return series().rowsBetween(1 - n, 0)


def log(c) -> Column:
    return F.log1p(F.col(c) if isinstance(c, str) else c)


def chapter_trends(g: DataFrame) -> DataFrame:
    """Chapter totals over all series: growth on the year and on the three months before; null where the axis has not begun."""
    w = W.partitionBy("chapter").orderBy("t")
    c = g.groupBy("chapter", "t", "i").agg(total("v").alias("c"))
    year = F.when(F.col("i") >= 12, log("c") - log(F.lag("c", 12).over(w)))
    quarter = F.when(F.col("i") >= 1, log("c") - log(F.avg("c").over(w.rowsBetween(-3, -1))))
    return c.select("chapter", "t", year.alias("chapter_growth"), quarter.alias("chapter_momentum"))


def partner_rank(g: DataFrame, top: int) -> DataFrame:
    """At each month the partners with most value up to then keep their name."""
    w = W.partitionBy("partner").orderBy("t")
    c = g.groupBy("partner", "t").agg(total("v").alias("v")).withColumn("v", F.sum(F.col("v").cast("decimal(18,2)")).over(w))
    r = F.row_number().over(W.partitionBy("t").orderBy(F.desc("v"), "partner"))
    return c.select("partner", "t", F.when(r <= top, F.col("partner")).otherwise(F.lit("other")).alias("partner_group"))


def features(g: DataFrame, h: int = 1, top: int = 40, commodities: tuple[str, ...] = ()) -> DataFrame:
    """Features of every series at every origin t, and the target at t + h, the only column that looks ahead. Months off the axis are null."""
    s = series()
    g = g.withColumn("l", log("v")).withColumn("on", (F.col("v") > 0).cast("int")).withColumn("uv", F.when((F.col("q") > 0) & (F.col("v") > 0), F.col("v") / F.col("q")))
    lag = lambda k: F.lag("l", k).over(s)
    sum3 = F.sum("v").over(last(3))
    base = g.select(
        "*",
        *[(F.col("l") if k == 0 else lag(k)).alias(f"lag_{k}") for k in range(6)],
        lag(12 - h).alias("lag_seasonal") if h < 12 else F.col("l").alias("lag_seasonal"),
        lag(12).alias("lag_12"),
        *[F.avg("l").over(last(n)).alias(f"mean_log_{n}") for n in (3, 6, 12)],
        *[log(F.avg("v").over(last(n))).alias(f"log_mean_{n}") for n in (3, 12)],
        F.stddev_pop("l").over(last(12)).alias("sd_log_12"),
        *[F.sum("on").over(last(n)).alias(f"active_{n}") for n in (3, 6, 12)],
        F.coalesce(F.col("t") - F.max(F.when(F.col("on") == 1, F.col("t"))).over(last(12)), F.lit(12)).alias("since_active"),
        sum3.alias("_s3"),
        F.percentile("uv", F.lit(0.5)).over(last(12)).alias("_uv_median"),
        log("n_decl").alias("log_n_decl"),
        log(F.avg("n_firms").over(last(3))).alias("log_n_firms_3"),
        F.lag("on", 1).over(s).alias("on_1"),
        F.lag("on", 2).over(s).alias("on_2"),
        F.lag("on", 12 - h).over(s).alias("on_seasonal"),
        F.lead("v", h).over(s).alias("target"),
        (((F.col("t") + h - 1) % 12) + 1).alias("target_month"),
    )
    base = base.withColumn("_s3_12", F.lag("_s3", 12).over(s))
    out = base.select(
        *KEYS, "chapter", "t", "i", "v", *[f"lag_{k}" for k in range(6)], "lag_seasonal", "lag_12", "mean_log_3", "mean_log_6", "mean_log_12", "log_mean_3", "log_mean_12",
        *[(F.col(c) - F.col("log_mean_3")).alias(f"rel_{c}") for c in ("lag_0", "lag_1", "lag_2", "lag_seasonal", "lag_12", "log_mean_12")],
        "sd_log_12", "active_3", "active_6", "active_12", "since_active",
        (F.col("lag_seasonal") - F.col("mean_log_12")).alias("seasonal_gap"),
        F.when(F.col("i") >= 14, log("_s3") - log("_s3_12")).alias("growth_3m"),
        F.log(F.when(F.col("uv").isNotNull(), F.col("uv") / F.col("_uv_median"))).alias("price_gap"),
        "log_n_decl", "log_n_firms_3", "on", "on_1", "on_2", "on_seasonal", "target_month", F.col("chapter").isin(*commodities).alias("commodity") if commodities else F.lit(False).alias("commodity"),
        (F.col("active_12") >= 10).alias("regular"), F.col("active_12").between(1, 9).alias("intermittent"), "target",
    )
    return out.join(chapter_trends(g), ["chapter", "t"]).join(partner_rank(g, top), ["partner", "t"])


def baselines(g: DataFrame, h: int = 1) -> DataFrame:
    """Forecasts for t + h from values up to t: the last, the same month a year before, that one with the year's trend (0.2 to 5; 1 before two years), the mean of three."""
    s = series()
    g = g.withColumn("_s3", F.sum("v").over(last(3)))
    g = g.select("*", F.lag("v", 12 - h).over(s).alias("seasonal"), F.lag("_s3", 12).over(s).alias("_p3"), F.avg("v").over(last(3)).alias("mean_3"), F.lead("v", h).over(s).alias("y"), F.sum((F.col("v") > 0).cast("int")).over(last(12)).alias("active_12"))
    ratio = F.when((F.col("i") >= 14) & (F.col("_p3") > 0), F.least(F.lit(5.0), F.greatest(F.lit(0.2), F.col("_s3") / F.col("_p3")))).otherwise(F.lit(1.0))
    return g.where(F.col("i") >= FIRST_ORIGIN).select(*KEYS, "chapter", "t", "i", "active_12", "y", F.col("v").alias("naive"), "seasonal", (F.col("seasonal") * ratio).alias("seasonal_trend"), "mean_3")
