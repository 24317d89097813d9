"""Running sums over a whole table, or a few large groups, without a task that sees all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges that a group's order is cut into, at approximate quantiles.
RANGES = 128


def running(rows: DataFrame, by: list[str], order: Column, sums: dict[str, Column], then: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with the running sums up to each row in the order of `order` and `then`, and the groups' totals as all_<name>.

    A row's range depends on `order` alone, so rows that are equal in it stay together; sums are taken by range, then within one. Rows without an order stand first.
    """
    o = rows.withColumn("_o", order.cast("double"))
    cuts = o.groupBy(*by).agg(F.percentile_approx("_o", F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), F.lit(1000)).alias("_cuts"))
    tagged = o.join(cuts, by) if by else o.crossJoin(cuts)
    tagged = tagged.withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_o"))), F.lit(0))).drop("_cuts")
    parts = tagged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_in_{n}") for n, c in sums.items()])
    own = W.partitionBy(*by)
    earlier = own.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = parts.select(*by, "_range", *[F.coalesce(F.sum(f"_in_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums], *[F.sum(f"_in_{n}").over(own).alias(f"all_{n}") for n in sums])
    upto = W.partitionBy(*by, "_range").orderBy("_o", *then).rowsBetween(W.unboundedPreceding, 0)
    within = tagged.select("*", *[F.sum(c).over(upto).alias(f"_in_{n}") for n, c in sums.items()])
    out = within.join(before, [*by, "_range"])
    return out.select(*rows.columns, *[(F.col(f"_before_{n}") + F.coalesce(f"_in_{n}", F.lit(0))).alias(n) for n in sums], *[f"all_{n}" for n in sums])
