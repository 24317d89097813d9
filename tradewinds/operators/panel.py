"""Imputation, segments and the monthly panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNKNOWN_PRODUCT = "000000"


def money(c) -> Column:
    """Exact sums: amounts have two decimals."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("decimal(18,2)")


def total(c) -> Column:
    """Sum of amounts, 0 of none."""
    return F.coalesce(F.sum(money(c)), F.lit(0)).cast("double")


def segment(operation: Column, mapping: dict[str, list[str]], default: str) -> Column:
    out = None
    for name, codes in mapping.items():
        out = F.when(operation.isin(codes), name) if out is None else out.when(operation.isin(codes), name)
    return F.coalesce(out.otherwise(F.lit(default)), F.lit(default))


def impute(items: DataFrame) -> DataFrame:
    """A declaration's only missing item value is its header less the known items; `imputed` marks them. Declarations without id are left alone."""
    w = W.partitionBy("period", "decl")
    nulls = F.sum(F.col("item_value").isNull().cast("int")).over(w)
    known = F.coalesce(F.sum(money("item_value")).over(w), F.lit(0).cast("decimal(18,2)"))
    target = F.col("item_value").isNull() & (nulls == 1) & F.col("decl").isNotNull() & F.col("header_value").isNotNull()
    marked = items.withColumn("_rest", (money("header_value") - known).cast("double")).withColumn("imputed", target)
    return marked.withColumn("item_value", F.when(F.col("imputed"), F.col("_rest")).otherwise(F.col("item_value"))).drop("_rest")


def imputation_report(items: DataFrame) -> DataFrame:
    done = impute(items)
    return done.agg(
        F.count_if(F.col("item_value").isNull() | F.col("imputed")).alias("null_items"),
        F.count_if("imputed").alias("imputed"),
        total(F.when(F.col("imputed"), F.col("item_value"))).alias("imputed_value"),
    )


def panel(items: DataFrame) -> DataFrame:
    """One row a period, segment, product and partner, from items with a value; rows without a key are left out."""
    rows = impute(items).withColumn("product", F.coalesce("product", F.lit(UNKNOWN_PRODUCT))).dropna(subset=["item_value", "period", "segment", "product", "partner"])
    return rows.groupBy("period", "t", "segment", "product", "partner").agg(
        total("item_value").alias("value"),
        total("qty").alias("quantity"),
        F.count("*").alias("n_items"),
        F.countDistinct("decl").alias("n_decl"),
        F.countDistinct("trader").alias("n_firms"),
        F.first("pseudo").alias("pseudo"),
        F.min("chapter").alias("chapter"),
    )


def goods(rows: DataFrame, name: str = "bienes") -> DataFrame:
    return rows.where((F.col("segment") == name) & ~F.col("pseudo") & (F.col("product") != UNKNOWN_PRODUCT))
