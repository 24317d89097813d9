"""Samples of labelled documents for the classifiers, which train on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewinds.llm._io import crc_mod, sample_ids


def labelled(labels: DataFrame, column: str, n: int, out: int) -> DataFrame:
    """Ids whose crc32 modulo n is not `out`, each with one label: the largest, where rows differ. Null ids and labels are left out."""
    rows = labels.select(F.col("doc_id").alias("id"), F.col(column).cast("int").alias("label")).where("id is not null and label is not null")
    return rows.where(crc_mod(F.col("id"), n) != out).groupBy("id").agg(F.max("label").alias("label"))


def bounded(pairs: DataFrame, most: int) -> DataFrame:
    """At most `most` labelled ids, smallest by hash; small enough to broadcast by that bound."""
    return pairs.orderBy(F.xxhash64("id"), "id").limit(most)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, label and text of the documents with those ids; of a repeated id the text with the smallest hash, so no more rows than ids."""
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(ids), "id")
    return rows.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def unlabelled(docs: DataFrame, n: int, out: int, most: int) -> DataFrame:
    ids = docs.select(F.col("doc_id").alias("id")).where(crc_mod(F.col("id"), n) != out)
    return sample_ids(ids, most).withColumn("label", F.lit(-1))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Adam:
    """First-order steps with running moments of the gradient."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        return w - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
