"""Exploratory queries over items and panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewinds.operators.panel import money, total
from tradewinds.operators.ranks import running

def year() -> Column:
    return F.substring("period", 1, 4)


def r6(c: Column) -> Column:
    return F.round(c, 6)


def yearly(panel: DataFrame) -> DataFrame:
    return panel.groupBy(year().alias("year")).agg(total("value").alias("value"), total(F.when(F.col("segment") == "bienes", F.col("value"))).alias("goods"))


def segment_share(panel: DataFrame) -> DataFrame:
    by = panel.groupBy("segment").agg(total("value").alias("value"))
    return by.withColumn("share", r6(100 * F.col("value") / F.sum("value").over(W.partitionBy())))


def header_inflation(items: DataFrame) -> DataFrame:
    """Summing the repeated header against summing items, and items a declaration."""
    per = items.groupBy("decl").agg(F.count("*").alias("n"))
    sums = items.agg(total("item_value").alias("right_total"), total("header_value").alias("wrong_total"))
    sizes = per.agg(F.percentile("n", F.lit(0.5)).alias("median_items"), F.max("n").alias("max_items"))
    return sums.crossJoin(F.broadcast(sizes)).withColumn("factor", r6(F.col("wrong_total") / F.col("right_total")))


def monthly(panel: DataFrame) -> DataFrame:
    return panel.groupBy("period").agg(total("value").alias("value"))


def year_to_date(panel: DataFrame, last_month: int = 8) -> DataFrame:
    part = panel.where(F.substring("period", 6, 2).cast("int") <= last_month).groupBy(year().alias("year")).agg(total("value").alias("value"))
    return part.withColumn("growth", r6(100 * (F.col("value") / F.lag("value").over(W.orderBy("year")) - 1)))


def contribution(panel: DataFrame, a: str, b: str, top: int = 6, bottom: int = 5) -> DataFrame:
    """Change by chapter between two years; the largest and smallest changes."""
    wide = panel.withColumn("_y", year()).where(F.col("_y").isin(a, b)).groupBy("chapter").pivot("_y", [a, b]).agg(total("value"))
    wide = wide.na.fill(0.0).select("chapter", F.col(a).alias("before"), F.col(b).alias("after"))
    out = wide.withColumn("delta", F.round(F.col("after") - F.col("before"), 2)).withColumn("change", r6(F.when(F.col("before") > 0, 100 * (F.col("after") / F.col("before") - 1))))
    up, down = F.row_number().over(W.orderBy(F.desc("delta"), "chapter")), F.row_number().over(W.orderBy("delta", "chapter"))
    return out.withColumn("_u", up).withColumn("_d", down).where((F.col("_u") <= top) | (F.col("_d") <= bottom)).drop("_u", "_d")


def price_volume(panel: DataFrame, base_year: str, roll: int = 3) -> DataFrame:
    """Unit value and volume indices, 100 in the base year (the mean of its months), and the volume's rolling mean."""
    by = panel.groupBy("period").agg(total("value").alias("v"), total("quantity").alias("q")).withColumn("uv", F.try_divide("v", "q"))
    base = by.where(F.substring("period", 1, 4) == base_year).agg(F.avg("uv").alias("b_uv"), F.avg("q").alias("b_q"))
    out = by.crossJoin(F.broadcast(base)).select("period", (100 * F.col("uv") / F.col("b_uv")).alias("price"), (100 * F.col("q") / F.col("b_q")).alias("volume"))
    rolled = F.avg("volume").over(W.orderBy("period").rowsBetween(1 - roll, 0))
    return out.select("period", r6(F.col("price")).alias("price"), r6(F.col("volume")).alias("volume"), r6(rolled).alias("volume_rolled"))


def top_shares(panel: DataFrame, key: str, n: int, eligible: Column | None = None) -> DataFrame:
    """Shares of the n largest keys among the eligible; everything else is 'rest'. The denominator is all value."""
    by = panel.groupBy(key).agg(total("value").alias("value"), F.max(eligible if eligible is not None else F.lit(True)).alias("_e"))
    ranked = by.withColumn("_r", F.when(F.col("_e"), F.row_number().over(W.orderBy(F.desc("_e"), F.desc("value"), key))))
    name = F.when(F.col("_r") <= n, F.col(key)).otherwise(F.lit("rest"))
    return ranked.groupBy(name.alias(key)).agg(F.round(F.sum("value"), 2).alias("value")).withColumn("share", r6(100 * F.col("value") / F.sum("value").over(W.partitionBy())))


def concentration(panel: DataFrame, key: str) -> DataFrame:
    """Keys by value with cumulative shares."""
    return _concentration(panel, key).drop("n")


def _concentration(panel: DataFrame, key: str) -> DataFrame:
    by = panel.groupBy(key).agg(total("value").alias("value"))
    sums = running(by, [], -F.col("value"), {"rank": F.lit(1), "upto": money("value")}, (key,))
    return sums.select(key, "value", F.col("rank").cast("long").alias("rank"), r6(100 * F.col("upto").cast("double") / F.col("all_upto").cast("double")).alias("cumulative"), F.col("all_rank").alias("n"))


def concentration_summary(panel: DataFrame, key: str) -> DataFrame:
    """How many keys hold 80 and 95 percent (null if none does), and the share of the first tenth."""
    c = _concentration(panel, key)
    tenth = F.max(F.when(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") / 10)), F.col("cumulative")))
    return c.agg(F.min(F.when(F.col("cumulative") >= 80, F.col("rank"))).alias("n80"), F.min(F.when(F.col("cumulative") >= 95, F.col("rank"))).alias("n95"), tenth.alias("top_tenth"))


def firm_concentration(items: DataFrame, top: int = 10) -> DataFrame:
    """Herfindahl index times 10,000 and the share of the largest firms, by month."""
    by = items.dropna(subset=["trader"]).groupBy("period", "trader").agg(total("item_value").alias("v"))
    w = W.partitionBy("period")
    ranked = by.select("period", (F.col("v") / F.sum("v").over(w)).alias("s"), F.row_number().over(w.orderBy(F.desc("v"), "trader")).alias("r"))
    return ranked.groupBy("period").agg(F.round(10000 * F.sum(F.col("s") * F.col("s")), 4).alias("hhi"), r6(100 * F.sum(F.when(F.col("r") <= top, F.col("s")).otherwise(0.0))).alias("top_share"))


def id_stability(items: DataFrame, attribute: str) -> DataFrame:
    """Is an id one firm? Share of firm-months with one attribute value, of ids of several months with one value, and max id over ids in the median month."""
    pairs = items.dropna(subset=["trader"]).select("period", "trader", attribute).distinct()
    within = pairs.groupBy("period", "trader").agg(F.countDistinct(attribute).alias("k")).agg(r6(100 * F.avg((F.col("k") == 1).cast("double"))).alias("within_month"))
    across = pairs.groupBy("trader").agg(F.countDistinct(attribute).alias("k"), F.countDistinct("period").alias("m")).where("m > 1").agg(r6(100 * F.avg((F.col("k") == 1).cast("double"))).alias("across_months"))
    ratio = pairs.groupBy("period").agg((F.max("trader") / F.countDistinct("trader")).alias("x")).agg(r6(F.percentile("x", F.lit(0.5))).alias("id_ratio"))
    return within.crossJoin(across).crossJoin(ratio)  # one row each


def intermittency(panel: DataFrame, edges: list[int]) -> DataFrame:
    """Series by months with trade, in right-closed bins; empty bins are kept."""
    series = panel.groupBy("product", "partner").agg(F.countDistinct("period").alias("m"), total("value").alias("v"))
    spark = panel.sparkSession
    bins = spark.createDataFrame(list(zip(range(len(edges) - 1), edges, edges[1:])), "bin int, lo int, hi int")
    by = series.join(F.broadcast(bins), F.expr("m > lo and m <= hi")).groupBy("bin").agg(F.count("*").alias("series"), F.sum("v").alias("v"))
    out = bins.join(by, "bin", "left").select("bin", F.coalesce("series", F.lit(0)).alias("series"), F.coalesce("v", F.lit(0.0)).alias("v"))
    return out.select("bin", "series", r6(100 * F.col("series") / F.sum("series").over(W.partitionBy())).alias("series_share"), r6(100 * F.col("v") / F.sum("v").over(W.partitionBy())).alias("value_share"))


def describe(items: DataFrame, column: str) -> DataFrame:
    x = F.col(column)
    p = lambda q: F.percentile(column, F.lit(q))
    return items.agg(F.count(x).alias("n"), r6(F.avg(x)).alias("mean"), F.round(F.stddev_samp(x), 4).alias("sd"), F.min(x).alias("least"), r6(p(0.5)).alias("p50"), r6(p(0.9)).alias("p90"), r6(p(0.99)).alias("p99"), r6(p(0.999)).alias("p999"), F.max(x).alias("most"))


def log_histogram(items: DataFrame, column: str, edges: int = 80, top: float = 9.5) -> DataFrame:
    """Shares of positive values in log-spaced bins from 1 to 10**top."""
    width = top / (edges - 1)
    x = items.where(F.col(column) >= 1).select(F.floor(F.log10(column) / width).cast("int").alias("bin"))
    return x.groupBy("bin").agg(F.count("*").alias("n")).withColumn("share", r6(100 * F.col("n") / F.sum("n").over(W.partitionBy())))


def quality_checks(items: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Repeated item keys beyond the first, missing and negative items, and declarations that differ from their header."""
    keys = items.groupBy("period", "decl", "item").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("duplicates"))
    rows = items.agg(F.count_if(F.col("item_value").isNull()).alias("null_items"), F.count_if(F.col("item_value") < 0).alias("negative_items"))
    decl = items.groupBy("period", "decl").agg(total("item_value").alias("s"), F.max("header_value").alias("h"), F.count_if(F.col("item_value").isNull()).alias("k"))
    off = F.abs(F.col("s") - F.col("h")) > tolerance * F.abs(F.col("h"))
    sums = decl.agg(F.count_if(off).alias("off"), F.count_if(off & (F.col("k") > 0)).alias("off_with_null"), r6(100 * F.avg((~off).cast("double"))).alias("consistent"))
    return keys.crossJoin(rows).crossJoin(sums)  # one row each


def generalists(firm_products: DataFrame, limits: list[int]) -> DataFrame:
    """Firm-months with more than k products, and their part of all product pairs."""
    k = firm_products.groupBy("period", "trader").agg(F.count("*").alias("k")).withColumn("p", F.col("k") * (F.col("k") - 1) / 2)
    lim = firm_products.sparkSession.createDataFrame([(x,) for x in limits], "more_than int")
    return k.crossJoin(F.broadcast(lim)).groupBy("more_than").agg(
        r6(100 * F.avg((F.col("k") > F.col("more_than")).cast("double"))).alias("firm_months"),
        r6(100 * F.try_divide(F.sum(F.when(F.col("k") > F.col("more_than"), F.col("p")).otherwise(0.0)), F.sum("p"))).alias("pairs"),
    )


def threshold_sweep(firm_products: DataFrame, limits: list[int]) -> DataFrame:
    """What a least value of a firm-month's product keeps, by threshold."""
    lim = firm_products.sparkSession.createDataFrame([(x,) for x in limits], "least int")
    rows = firm_products.crossJoin(F.broadcast(lim))
    kept = F.col("v") >= F.col("least")
    per = rows.groupBy("least", "period", "trader").agg(F.count_if(kept).alias("k"), F.count("*").alias("n"), F.sum(money("v")).alias("v"), F.sum(F.when(kept, money("v"))).alias("kv"))
    return per.groupBy("least").agg(
        F.sum("k").alias("pairs"),
        r6(100 * (1 - F.sum("k") / F.sum("n"))).alias("removed"),
        r6(100 * F.coalesce(F.sum("kv"), F.lit(0)).cast("double") / F.sum("v").cast("double")).alias("value_kept"),
        r6(100 * F.try_divide(F.count_if(F.col("k") == 1), F.count_if(F.col("k") > 0))).alias("single"),
    )


def flows(panel: DataFrame, community: DataFrame, top: int = 12) -> DataFrame:
    """Value from each market to each product community; markets beyond the top are 'rest'; each community's effective number of markets."""
    rank = F.row_number().over(W.orderBy(F.desc("_v"), "partner"))
    big = panel.groupBy("partner").agg(total("value").alias("_v")).withColumn("_r", rank).where(F.col("_r") <= top).select("partner", F.col("partner").alias("market"))
    rows = panel.join(community, "product").join(big, "partner", "left").withColumn("market", F.coalesce("market", F.lit("rest")))
    by = rows.groupBy("community", "market").agg(total("value").alias("value"))
    w = W.partitionBy("community")
    s = by.withColumn("s", F.col("value") / F.sum("value").over(w))
    return s.groupBy("community").agg(r6(1 / F.sum(F.col("s") * F.col("s"))).alias("effective"), F.max_by("market", F.struct("value", "market")).alias("main"), r6(F.max("s")).alias("main_share"), F.round(F.sum("value"), 2).alias("value"))


def modal_label(items: DataFrame, label: str = "chapter", shortest: int = 3) -> DataFrame:
    """The label with most value of each product; of equal ones the last by name."""
    by = items.where(F.length(label) >= shortest).groupBy("product", label).agg(total("item_value").alias("v"))
    return by.groupBy("product").agg(F.max_by(label, F.struct("v", label)).alias("label"))


def autocorrelation(panel: DataFrame, lags: list[int]) -> DataFrame:
    """Mean over series of the correlation of log values with their own lags, on months with trade."""
    w = W.partitionBy("product", "partner").orderBy("period")
    rows = panel.groupBy("product", "partner", "period").agg(total("value").alias("v")).withColumn("x", F.log1p(F.greatest("v", F.lit(0.0))))
    per = rows.select("product", "partner", "x", *[F.lag("x", k).over(w).alias(f"l{k}") for k in lags]).groupBy("product", "partner").agg(*[F.corr("x", f"l{k}").alias(f"c{k}") for k in lags])
    return per.agg(*[F.round(F.avg(F.nanvl(f"c{k}", F.lit(None).cast("double"))), 4).alias(f"lag{k}") for k in lags])
