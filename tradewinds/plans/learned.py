"""Queries of fitted models; they have no SQL form.

The axis of the test tables has 80 months: the last 14 are forecast, 6 of validation and 8 of test, at horizons of 1 to 3 months. Models here have TREES trees at a
rate of RATE, where the operators' defaults are those of the survey (500 at 0.03).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tradewinds.operators import drift as R
from tradewinds.operators import features as X
from tradewinds.operators import metrics as M
from tradewinds.operators import models as L
from tradewinds.operators import splits as S
from tradewinds.plans.forecasts import COMMODITY, METHODS, grid
from tradewinds.plans.graphs import _density
from tradewinds.shared import materialise

ORACLE = {}
TARGETS, HORIZONS, VALIDATION = range(66, 80), (1, 2, 3), 6
TREES, RATE = 80, 0.12
ACTIVITY = L.Config(loss="logistic", encoding="raw", trees=TREES, rate=RATE)


def frames(s, d, h=1):
    """The features of all series that were active in the last twelve months, and the grid; both are read many times, so they are written."""
    g = materialise(grid(s, d))
    return g, materialise(X.features(g, h, 10, (COMMODITY,)).withColumn("active", F.col("regular") | F.col("intermittent")))


def origins(h):
    return [m - h for m in TARGETS]


def walked(s, d, cfg, retrain=True, horizons=HORIZONS):
    out = []
    for h in horizons:
        g, x = frames(s, d, h)
        pred = L.walk_forward(x, h, origins(h), cfg, retrain, "active")
        out.append(pred.drop("y", "i").join(X.baselines(g, h), ["product", "partner", "t"]).withColumn("h", F.lit(h)))
    return reduce(lambda a, b: a.unionByName(b), out)


def forecast(**cfg):
    return lambda s, d: M.score(walked(s, d, L.Config(trees=TREES, rate=RATE, **cfg)), ["model", *METHODS], ["h"])


def frozen_and_retrained(s, d):
    """Both walk-forwards of one horizon side by side."""
    g, x = frames(s, d)
    cfg = L.Config(trees=TREES, rate=RATE)
    a, b = (L.walk_forward(x, 1, origins(1), cfg, retrain, "active") for retrain in (False, True))
    both = a.withColumnRenamed("model", "frozen").join(b.select("product", "partner", "t", F.col("model").alias("retrained")), ["product", "partner", "t"])
    return both.join(X.baselines(g, 1).select("product", "partner", "t", "mean_3"), ["product", "partner", "t"])


def monitored(s, d):
    at = F.col("i") < TARGETS[0] - 1 + VALIDATION
    return R.monitor(materialise(frozen_and_retrained(s, d)), ["frozen", "retrained", "mean_3"], at)


def activity(s, d, graph):
    _, x = frames(s, d)
    columns = L.ACTIVITY
    if graph:
        x, columns = L.with_graph(x, _density(s, d)), [*L.ACTIVITY, "density"]
    return M.classification(L.activity_walk_forward(x, origins(1), columns, ACTIVITY), "y", "p", [])


def split(s, d):
    _, x = frames(s, d)
    return S.chrono_split(L.training(x, 79, 1, "active"), "t", [0.5, 0.2, 0.3])


def folds(s, d):
    _, x = frames(s, d)
    rows = L.latest_status(x.where("target is not null")).withColumn("label", (F.col("target") > 0).cast("int"))
    return M.classification(L.out_of_fold(rows, L.ACTIVITY, "label", "product"), "label", "p", [])


QUERIES = {
    "mlm06_absolute": forecast(),
    "mlm06_squared": forecast(loss="squared", encoding="log1p"),
    "mlm06_huber": forecast(loss="huber"),
    "mlm06_tweedie": forecast(loss="tweedie", encoding="raw_offset"),
    "mlm07_frozen": lambda s, d: M.score(frozen_and_retrained(s, d), ["frozen", "retrained", "mean_3"], []),
    "mlm09_activity": lambda s, d: activity(s, d, False),
    "mlm15_activity_graph": lambda s, d: activity(s, d, True),
    "mlm11_out_of_fold": folds,
    "mlm12_rounds": lambda s, d: L.fit_evaluate(split(s, d), "part", L.Config(trees=2000, rate=RATE)),
    "mlm13_curves": lambda s, d: L.curves(split(s, d), "part", L.sweep(L.Config(trees=2000, rate=RATE), [7, 15, 31, 63], [0.1, 0.25, 0.5, 1.0])),
    "mlm14_contributions": lambda s, d: L.contributions(L.training(frames(s, d)[1], 79, 1, "active"), L.Config(trees=TREES, rate=RATE)),
    "spl06_same_rows": lambda s, d: M.score(L.random_against_walk(frames(s, d)[1], 1, origins(1), L.Config(trees=TREES, rate=RATE), "active"), ["random", "walk"], []),
    "drf13_monitor": monitored,
    "drf15_scenarios": lambda s, d: R.scenarios(monitored(s, d)),
}
