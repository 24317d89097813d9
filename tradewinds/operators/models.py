"""Global forecasting and activity models on the feature frame: boosted trees with nulls of their own.

The feature frame is computed once for all origins; a walk-forward is a filter of it: origins up to t0 - h train, origin t0 is scored. Fits are independent,
so each is a task over at most MOST_ROWS of its rows, all of them at once; rows are scored where they are.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewinds.operators import boosting
from tradewinds.operators.features import FIRST_ORIGIN
from tradewinds.operators.splits import random_split
from tradewinds.shared import materialise

NUMERIC = [
    "lag_0", "lag_1", "lag_2", "lag_seasonal", "lag_12", "mean_log_3", "mean_log_6", "mean_log_12", "log_mean_3", "log_mean_12", "rel_lag_0", "rel_lag_seasonal", "rel_log_mean_12",
    "sd_log_12", "active_12", "since_active", "seasonal_gap", "growth_3m", "price_gap", "log_n_decl", "log_n_firms_3", "chapter_growth", "chapter_momentum", "target_month",
]
ACTIVITY = [*NUMERIC, "active_3", "active_6", "on", "on_1", "on_2", "on_seasonal"]
#: Rows that a fit takes at most; beyond, those with the smallest hashes of their keys.
MOST_ROWS = 30_000


@dataclass(frozen=True)
class Config:
    """loss: squared, absolute, huber, tweedie or logistic. encoding: log1p, delta (log ratio to the level), raw, or raw_offset (tweedie with the level as offset).

    weight: none, log or sqrt of the level. The rest as in boosting.Params.
    """

    loss: str = "absolute"
    encoding: str = "delta"
    weight: str = "none"
    trees: int = 500
    rate: float = 0.03
    leaves: int = 31
    least: int = 50
    rows: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    seed: int = 42

    def params(self) -> boosting.Params:
        return boosting.Params(loss=self.loss, trees=self.trees, rate=self.rate, leaves=self.leaves, least=self.least, rows=self.rows, columns=self.columns, l2=self.l2, seed=self.seed)


def encode(kind: str) -> Column:
    y = F.col("target")
    return {"log1p": F.log1p(y), "delta": F.log1p(y) - F.col("log_mean_3"), "raw": y, "raw_offset": y}[kind]


def decode(kind: str, p: Column) -> Column:
    """Values from what `encode` gave; of raw_offset, from the ratio to the level's exponential."""
    out = {"log1p": F.expm1(p), "delta": F.expm1(p + F.col("log_mean_3")), "raw": p, "raw_offset": p * F.exp("log_mean_3")}[kind]
    return F.when(out.isNotNull(), F.greatest(F.lit(0.0), out))


def weight(kind: str) -> Column:
    level = F.expm1(F.greatest("mean_log_12", F.lit(0.0)))
    return {"none": F.lit(1.0), "log": F.log1p(level) + 1e-3, "sqrt": F.sqrt(level) + 1e-3}[kind]


def training(frame: DataFrame, t0: int, h: int, population: str = "regular") -> DataFrame:
    """Rows whose target is known at month index t0: origins FIRST_ORIGIN to t0 - h, of the population at each origin."""
    return frame.where((F.col("i") >= FIRST_ORIGIN) & (F.col("i") <= t0 - h) & F.col(population) & F.col("target").isNotNull())


def _numbers(columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns]).alias("x")


def _matrix(rows: pa.Table | pa.RecordBatch, k: int) -> np.ndarray:
    """Column x, missing values as NaN."""
    x = rows.column("x")
    x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, k)


def _ordered(group: pa.Table) -> pa.Table:
    return group.sort_by([("p", "ascending"), ("y", "ascending")])


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def fit_each(rows: DataFrame, configs: dict[int, Config], columns: list[str], y: Column, fits: Column, keys: list[str], share: dict[int, float] | None = None) -> dict[int, boosting.Model]:
    """A model for each fit. `fits`: the array of the fits that a row trains; `share`: the part of its rows that a fit takes, all by default.

    Rows of a fit beyond MOST_ROWS are left out by a hash of `keys`. Fits without rows have no model. Models of some hundred kB each come to the driver.
    """
    one = next(iter(configs.values()))
    off = F.col("log_mean_3") if one.encoding == "raw_offset" else F.lit(0.0)
    w = weight(one.weight) if one.weight != "none" else F.lit(1.0)
    place = F.pmod(F.xxhash64(*keys), F.lit(1_000_000)) / 1e6
    counts = {r["fit"]: r["n"] for r in rows.select(F.explode(fits).alias("fit")).groupBy("fit").agg(F.count("*").alias("n")).collect()}  # one row a fit
    take = {k: min((share or {}).get(k, 1.0), MOST_ROWS / n) for k, n in counts.items()}
    if not take:
        return {}
    dealt = rows.select(_numbers(columns), y.cast("double").alias("y"), w.alias("w"), off.cast("double").alias("o"), place.alias("p"), F.explode(fits).alias("fit"))
    kept = dealt.where(F.col("p") < F.element_at(F.create_map(*[F.lit(v) for kv in take.items() for v in kv]), F.col("fit")))

    def run(group: pa.Table) -> pa.Table:
        group = _ordered(group)
        k = group.column("fit")[0].as_py()
        model = boosting.fit(_matrix(group, len(columns)), _column(group, "y"), configs[k].params(), _column(group, "w"), _column(group, "o"))
        return pa.table({"fit": pa.array([k], pa.int32()), "model": pa.array([zlib.compress(pickle.dumps(model))], pa.binary())})

    got = kept.repartitionByRange(len(take), "fit").groupBy("fit").applyInArrow(run, "fit int, model binary").collect()
    return {r["fit"]: pickle.loads(zlib.decompress(r["model"])) for r in got}


def score_each(rows: DataFrame, models: dict[int, boosting.Model], columns: list[str], link: str = "identity") -> DataFrame:
    """`rows`, which have a column `fit`, with the score `_p` of its model; null without one. link: identity, exp or logistic."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, _p double"
    names = rows.columns

    def run(batches):
        for batch in batches:
            x, fit = _matrix(batch, len(columns)), batch.column("fit").to_numpy(zero_copy_only=False)
            p = np.full(len(x), np.nan)
            for k, model in models.items():
                at = np.flatnonzero(fit == k)
                if len(at):
                    p[at] = model.score(x[at])
            p = np.exp(np.minimum(p, 30)) if link == "exp" else 1 / (1 + np.exp(-np.clip(p, -40, 40))) if link == "logistic" else p
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in range(len(names))], pa.array(p)], [*names, "_p"])

    return rows.select(*names, _numbers(columns)).mapInArrow(run, schema).withColumn("_p", F.nanvl("_p", F.lit(None).cast("double")))


def walk_forward(frame: DataFrame, h: int, origins: list[int], cfg: Config = Config(), retrain: bool = True, population: str = "regular") -> DataFrame:
    """Forecasts at each origin by a model of what is known there, or by the first origin's model throughout."""
    fits = list(origins) if retrain else [min(origins)]
    rows = training(frame, max(fits), h, population)
    each = F.filter(F.array(*map(F.lit, fits)), lambda o: F.col("i") <= o - h)
    models = fit_each(rows, dict.fromkeys(fits, cfg), NUMERIC, encode(cfg.encoding), each, ["product", "partner", "i"])
    now = frame.where(F.col("i").isin(list(origins)) & F.col(population)).withColumn("fit", (F.col("i") if retrain else F.lit(fits[0])).cast("int"))
    out = score_each(now, models, NUMERIC, "exp" if cfg.loss == "tweedie" else "identity")
    return out.select("product", "partner", "t", "i", F.col("target").alias("y"), decode(cfg.encoding, F.col("_p")).alias("model"))


def activity_walk_forward(frame: DataFrame, origins: list[int], columns: list[str] | None = None, cfg: Config = Config(loss="logistic", encoding="raw", trees=400)) -> DataFrame:
    """Probability that an intermittent series trades next month; `columns` may add those of the graph."""
    columns = columns or ACTIVITY
    rows = training(frame, max(origins), 1, "intermittent")
    each = F.filter(F.array(*map(F.lit, origins)), lambda o: F.col("i") <= o - 1)
    models = fit_each(rows, dict.fromkeys(origins, cfg), columns, (F.col("target") > 0), each, ["product", "partner", "i"])
    now = frame.where(F.col("i").isin(list(origins)) & F.col("intermittent") & F.col("target").isNotNull()).withColumn("fit", F.col("i").cast("int"))
    out = score_each(now, models, columns, "logistic")
    return out.select("product", "partner", "t", (F.col("target") > 0).cast("int").alias("y"), F.coalesce("_p", F.lit(0.5)).alias("p"))


def out_of_fold(rows: DataFrame, columns: list[str], y: str, group: str, folds: int = 5, cfg: Config = Config(loss="logistic", encoding="raw", trees=100, rate=0.1)) -> DataFrame:
    """Probabilities of each row by a model that saw no row of its group; 0.5 where there was none to learn from."""
    data = rows.withColumn("fit", F.pmod(F.xxhash64(group), F.lit(folds)).cast("int"))
    each = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fit"))
    models = fit_each(data, dict.fromkeys(range(folds), cfg), columns, F.col(y), each, columns)
    out = score_each(data, models, columns, "logistic")
    return out.select(*rows.columns, F.coalesce("_p", F.lit(0.5)).alias("p"))


def _parts(rows: DataFrame, part: str, cfg: Config, fits: int) -> DataFrame:
    """Rows of the three parts with their numbers, within MOST_ROWS, once for each fit."""
    data = rows.select(_numbers(NUMERIC), encode(cfg.encoding).cast("double").alias("y"), F.col(part).alias("part"), (F.pmod(F.xxhash64("product", "partner", "t"), F.lit(1_000_000)) / 1e6).alias("p"))
    data = materialise(data)
    n = data.count()
    return data.where(F.col("p") < min(1.0, MOST_ROWS / max(n, 1))).withColumn("fit", F.explode(F.sequence(F.lit(0), F.lit(fits - 1))))


def _curve(group: pa.Table, cfg: Config, share: float, patience: int) -> list[tuple]:
    """tree, loss on train, validation and test after each tree; training rows within the share."""
    p = cfg.params()
    group = _ordered(group)
    part, place, y, x = _column(group, "part"), _column(group, "p"), _column(group, "y"), _matrix(group, len(NUMERIC))
    own = [np.flatnonzero((part == 0) & (place <= np.quantile(place[part == 0], share))) if (part == 0).any() else np.empty(0, int), np.flatnonzero(part == 1), np.flatnonzero(part == 2)]
    if not all(map(len, own)):
        return []
    out: list[tuple] = []
    held: dict = {}

    def watch(model, tree):
        if not held:
            held["codes"] = [model.codes(x[r]) for r in own]
            held["s"] = [np.full(len(r), model.base) for r in own]
        held["s"] = [s + boosting.leaf_values(tree, c) for s, c in zip(held["s"], held["codes"])]
        out.append((len(model.trees), *(boosting.loss(p, y[r], s, np.ones(len(r))) for r, s in zip(own, held["s"]))))
        return out[-1][2]

    boosting.fit(x[own[0]], y[own[0]], p, watch=watch, patience=patience)
    return out


def fit_evaluate(rows: DataFrame, part: str, cfg: Config = Config(trees=2000), patience: int = 100) -> DataFrame:
    """Losses by rounds on parts 0 (train), 1 (validation) and 2 (test), until `patience` rounds bring no better validation loss; the best round is marked."""
    data = _parts(rows, part, cfg, 1)

    def run(group: pa.Table) -> pa.Table:
        out = pd.DataFrame(_curve(group, cfg, 1.0, patience), columns=["rounds", "train", "validation", "test"]).astype({"rounds": "int32"})
        return pa.Table.from_pandas(out.assign(best=out["rounds"] == (out["rounds"][out["validation"].idxmin()] if len(out) else 0)), preserve_index=False)

    return data.groupBy("fit").applyInArrow(run, "rounds int, train double, validation double, test double, best boolean")


def curves(rows: DataFrame, part: str, settings: list[tuple[str, float, Config]], patience: int = 100) -> DataFrame:
    """The learning and complexity curves: for each (name, share of the training rows, configuration) the rounds of least validation loss and the losses there."""
    data = _parts(rows, part, settings[0][2], len(settings))

    def run(group: pa.Table) -> pa.Table:
        name, share, cfg = settings[group.column("fit")[0].as_py()]
        found = _curve(group, cfg, share, patience)
        best = min(found, key=lambda r: r[2]) if found else (0, np.nan, np.nan, np.nan)
        out = pd.DataFrame([(name, share, cfg.leaves, *best)], columns=["curve", "share", "leaves", "rounds", "train", "validation", "test"]).astype({"leaves": "int32", "rounds": "int32"})
        return pa.Table.from_pandas(out, preserve_index=False)

    return data.repartitionByRange(len(settings), "fit").groupBy("fit").applyInArrow(run, "curve string, share double, leaves int, rounds int, train double, validation double, test double")


def contributions(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Mean absolute contribution of each feature to the scores of a model of all rows, largest first; over at most MOST_ROWS of them."""
    data = rows.withColumn("part", F.lit(0))
    part = _parts(data, "part", cfg, 1)

    def run(group: pa.Table) -> pa.Table:
        group = _ordered(group)
        x = _matrix(group, len(NUMERIC))
        found = np.abs(boosting.contributions(boosting.fit(x, _column(group, "y"), cfg.params()), x)).mean(0)
        return pa.table({"feature": NUMERIC, "contribution": found})

    return part.groupBy("fit").applyInArrow(run, "feature string, contribution double")


def random_against_walk(frame: DataFrame, h: int, origins: list[int], cfg: Config = Config(), population: str = "regular", shares: tuple[float, ...] = (0.5, 0.2, 0.3)) -> DataFrame:
    """Forecasts of the same rows by a model of a random split, which has seen later months, and by the walk-forward: columns random and walk."""
    rows = materialise(random_split(training(frame, max(origins) + h, h, population), ["product", "partner", "t"], list(shares)))
    models = fit_each(rows.where("part = 0"), {0: cfg}, NUMERIC, encode(cfg.encoding), F.array(F.lit(0)), ["product", "partner", "i"])
    scored = score_each(rows.where((F.col("part") == 2) & F.col("i").isin(list(origins))).withColumn("fit", F.lit(0)), models, NUMERIC, "exp" if cfg.loss == "tweedie" else "identity")
    mine = scored.select("product", "partner", "t", decode(cfg.encoding, F.col("_p")).alias("random"))
    walk = walk_forward(frame, h, origins, cfg, True, population)
    return walk.withColumnRenamed("model", "walk").join(mine, ["product", "partner", "t"])


def with_graph(frame: DataFrame, density: DataFrame) -> DataFrame:
    """Density of a product and partner beside the features; null off the network."""
    return frame.join(density.select("product", "partner", "density"), ["product", "partner"], "left")


def latest_status(rows: DataFrame) -> DataFrame:
    r = F.row_number().over(W.partitionBy("product", "partner").orderBy(F.desc("t")))
    return rows.withColumn("_r", r).where("_r = 1").drop("_r")


def sweep(cfg: Config, leaves: list[int], shares: list[float]) -> list[tuple[str, float, Config]]:
    """Settings of `curves`: trees of several sizes on all rows, and shares of the rows."""
    return [("complexity", 1.0, replace(cfg, leaves=n)) for n in leaves] + [("learning", s, cfg) for s in shares]
