"""Forecast and classification metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewinds.operators.ranks import running


def score(pred: DataFrame, methods: list[str], by: list[str]) -> DataFrame:
    """WAPE, mean absolute log error, total bias and n of each method; forecasts are clipped at 0."""
    long = pred.where("y is not null").unpivot([*by, "y"], methods, "method", "f").where("f is not null").withColumn("f", F.greatest("f", F.lit(0.0)))
    n = F.sum(F.col("y").cast("decimal(18,2)")).cast("double")
    return long.groupBy(*by, "method").agg(
        F.round(F.try_divide(F.sum(F.abs(F.col("f") - F.col("y"))), n), 6).alias("wape"),
        F.round(F.avg(F.abs(F.log1p("f") - F.log1p("y"))), 6).alias("mae_log"),
        F.round(F.try_divide(F.sum(F.col("f") - F.col("y")), n), 6).alias("bias"),
        F.count("*").alias("n"),
    )


def hits(pred: DataFrame, score: str, y: str, keys: list[str], best: int = 100, first: int = 10) -> DataFrame:
    """Of the `best` rows by score those that came true, the first of them: ties by keys."""
    order = [F.desc(score), *keys]
    top = pred.orderBy(*order).limit(best)
    return top.where(F.col(y) > 0).orderBy(*order).limit(first)


def by_score(pred: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """Counts at each distinct score and running counts from the largest."""
    s = pred.groupBy(*by, p).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    return running(s, by, -F.col(p), {"tp": F.col("pos"), "k": F.col("n")}).withColumnsRenamed({"all_tp": "all_pos", "all_k": "all_n"})


def classification(pred: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """Average precision over distinct scores, ROC area by average ranks, Brier score, log loss and base rate."""
    c = by_score(pred, y, p, by)
    curve = c.groupBy(*by).agg(
        F.round(F.sum(F.try_divide(F.col("pos"), F.col("all_pos")) * F.col("tp") / F.col("k")), 6).alias("ap"),
        F.round(F.try_divide(F.sum(F.col("pos") * (F.col("all_n") - F.col("all_pos") - (F.col("k") - F.col("tp"))) + F.col("pos") * (F.col("n") - F.col("pos")) / 2), F.max("all_pos") * (F.max("all_n") - F.max("all_pos"))), 6).alias("auc"),
    )
    q = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col(p)))
    loss = pred.groupBy(*by).agg(F.round(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))), 6).alias("brier"), F.round(F.avg(-F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q))), 6).alias("log_loss"), F.round(F.avg(y), 6).alias("base_rate"))
    return curve.join(loss, by) if by else curve.crossJoin(loss)


def precision_recall(pred: DataFrame, y: str, p: str) -> DataFrame:
    c = by_score(pred, y, p, [])
    return c.select(F.round(p, 6).alias("threshold"), F.round(F.col("tp") / F.col("k"), 6).alias("precision"), F.round(F.col("tp") / F.col("all_pos"), 6).alias("recall"))


def threshold_table(pred: DataFrame, y: str, p: str, at: list[float]) -> DataFrame:
    limits = pred.sparkSession.createDataFrame([(x,) for x in at], "threshold double")
    rows = pred.join(F.broadcast(limits))  # a fixed list
    flag = F.col(p) >= F.col("threshold")
    return rows.groupBy("threshold").agg(
        F.round(100 * F.avg(flag.cast("double")), 6).alias("flagged"), F.round(F.try_divide(F.sum(F.when(flag, F.col(y)).otherwise(0)), F.count_if(flag)), 6).alias("precision"), F.round(F.try_divide(F.sum(F.when(flag, F.col(y)).otherwise(0)), F.sum(y)), 6).alias("recall"),
    )


def calibration(pred: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Mean score and outcome in bins of equal counts of rows by score."""
    edges = pred.agg(F.percentile(p, F.array(*[F.lit(k / bins) for k in range(1, bins)])).alias("e"))
    b = F.size(F.filter("e", lambda x: x < F.col(p)))
    return pred.join(F.broadcast(edges)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(y), 6).alias("mean_y"))


def precision_at(pred: DataFrame, y: str, p: str, ties: list[str], ks: list[int]) -> DataFrame:
    """Precision of the k best and its lift over the base rate."""
    r = F.row_number().over(W.orderBy(F.desc(p), *ties))
    best = pred.select(y, p, *ties).orderBy(F.desc(p), *ties).limit(max(ks)).withColumn("r", r)
    base = pred.agg(F.avg(y).alias("base"))
    limits = pred.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    return best.join(F.broadcast(limits), F.expr("r <= k")).join(F.broadcast(base)).groupBy("k").agg(F.round(F.avg(y), 6).alias("precision"), F.round(F.try_divide(F.avg(y), F.first("base")), 6).alias("lift"))


def months_won(pred: DataFrame, method: str, baseline: str) -> DataFrame:
    """In how many months the method's absolute errors sum to less than the baseline's."""
    by = pred.where(f"y is not null and {method} is not null and {baseline} is not null").groupBy("t").agg(F.sum(F.abs(F.col(method) - F.col("y"))).alias("a"), F.sum(F.abs(F.col(baseline) - F.col("y"))).alias("b"))
    return by.agg(F.count_if(F.col("a") < F.col("b")).alias("won"), F.count("*").alias("months"))


def bootstrap_difference(pred: DataFrame, cluster: list[str], a: str, b: str, replicates: int = 300, seed: int = 42) -> DataFrame:
    """Difference of two methods' WAPE with a 95 % interval: clusters drawn with Poisson(1) weights from a hash of cluster and replicate; sums are made by cluster first."""
    sums = pred.where("y is not null").groupBy(*cluster).agg(F.sum(F.abs(F.col(a) - F.col("y"))).alias("ea"), F.sum(F.abs(F.col(b) - F.col("y"))).alias("eb"), F.sum("y").alias("y"))
    u = F.pmod(F.xxhash64(*cluster, "r", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    # inverse of the Poisson(1) distribution function
    cuts = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]
    weight = sum(((u >= c).cast("int") for c in cuts[1:]), (u >= cuts[0]).cast("int"))
    drawn = sums.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("r")).withColumn("w", weight)
    per = drawn.groupBy("r").agg(F.try_divide(F.sum(F.col("w") * (F.col("ea") - F.col("eb"))), F.sum(F.col("w") * F.col("y"))).alias("d"))
    point = sums.agg(F.try_divide(F.sum(F.col("ea") - F.col("eb")), F.sum("y")).alias("difference"))
    return point.crossJoin(per.agg(F.percentile("d", F.lit(0.025)).alias("lo"), F.percentile("d", F.lit(0.975)).alias("hi")))
