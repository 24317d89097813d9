"""Split schemes over (series, month) rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _part(position: Column, n: Column, fractions: list[float]) -> Column:
    """Part by cumulative half-even rounded counts, in decimals, so that a half is one (45 * 0.7 as doubles is below 31.5); the last takes the rest."""
    run, out = Decimal(0), None
    for k, f in enumerate(fractions[:-1]):
        run += Decimal(str(f))
        cut = position <= F.bround(n.cast("decimal(18,0)") * F.lit(run))
        out = F.when(cut, k) if out is None else out.when(cut, k)
    return out.otherwise(len(fractions) - 1)


def random_split(rows: DataFrame, keys: list[str], fractions: list[float], seed: int = 42) -> DataFrame:
    """Exact sizes: rows ranked by an arithmetic hash of an id, so that any engine repeats it. Ranks are taken in two steps: counts of 1,024 ranges of the hash, then ranks within."""
    h = F.pmod(F.abs(F.hash(*keys)).cast("long") * 2654435761 + seed * 40503, F.lit(4294967296))
    rows = rows.withColumn("_h", h).withColumn("_b", F.shiftright("_h", 22))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_c"))
    counts = counts.select("_b", F.coalesce(F.sum("_c").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(W.partitionBy()).alias("_n"))
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy("_h", *keys))).join(F.broadcast(counts), "_b")  # 1,024 rows at most
    return ranked.withColumn("part", _part(F.col("_r") + F.col("_before"), F.col("_n"), fractions)).drop("_h", "_b", "_before", "_n", "_r")


def chrono_split(rows: DataFrame, month: str, fractions: list[float]) -> DataFrame:
    """Whole months to parts in order."""
    m = rows.select(month).distinct()
    m = m.withColumn("part", _part(F.row_number().over(W.orderBy(month)), F.count("*").over(W.partitionBy()), fractions))
    return rows.join(F.broadcast(m), month)


def sizes(split: DataFrame, parts: int) -> DataFrame:
    """part, n: rows of each part, 0 for parts without any."""
    counts = F.array(*[F.struct(F.lit(k).alias("part"), F.count_if(F.col("part") == k).alias("n")) for k in range(parts)])
    return split.agg(counts.alias("_a")).select(F.inline("_a"))


def composition(split: DataFrame, month: str) -> DataFrame:
    n = F.count("*")
    return split.groupBy(month, "part").agg(n.alias("n")).withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy(month)), 6))
