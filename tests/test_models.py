import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewinds.operators import boosting as B
from tradewinds.operators import drift as R
from tradewinds.operators import features as X
from tradewinds.operators import models as L
from tradewinds.operators import splits as S


def noisy(n=4000, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 5))
    x[rng.random((n, 5)) < 0.1] = np.nan
    return rng, x, np.where(np.isnan(x[:, 0]), 1.5, np.sin(2 * np.nan_to_num(x[:, 0]))) + 0.5 * np.nan_to_num(x[:, 1])


@pytest.mark.parametrize("loss,share", [("squared", 0.1), ("absolute", 0.25), ("huber", 0.1), ("tweedie", 0.995), ("logistic", 0.9)])
def test_boosting_explains_each_loss(loss, share):
    rng, x, f = noisy()
    y = {"tweedie": lambda: rng.poisson(np.exp(f)).astype(float), "logistic": lambda: (rng.random(len(f)) < 1 / (1 + np.exp(-3 * f))).astype(float)}.get(loss, lambda: f + 0.1 * rng.standard_normal(len(f)))()
    p = B.Params(loss=loss, trees=80, rate=0.1)
    m = B.fit(x[:3000], y[:3000], p)
    w = np.ones(1000)
    assert B.loss(p, y[3000:], m.score(x[3000:]), w) < share * B.loss(p, y[3000:], np.full(1000, m.base), w)
    assert (B.fit(x[:3000], y[:3000], p).score(x) == m.score(x)).all()


@pytest.mark.parametrize("loss", ["squared", "huber", "tweedie", "logistic"])
def test_slopes_are_the_derivatives(loss):
    rng = np.random.default_rng(1)
    y, s, p = rng.integers(0, 2, 50).astype(float), rng.standard_normal(50), B.Params(loss=loss)
    g, h = B.slopes(p, y, s)
    at = lambda t: np.array([B.loss(p, y[k : k + 1], t[k : k + 1], np.ones(1)) for k in range(50)])
    scale = 2 if loss == "squared" else 1  # the squared loss is reported without its half
    assert np.allclose(g * scale, (at(s + 1e-6) - at(s - 1e-6)) / 2e-6, atol=1e-4)
    if loss in ("tweedie", "logistic"):
        assert np.allclose(h, (B.slopes(p, y, s + 1e-6)[0] - B.slopes(p, y, s - 1e-6)[0]) / 2e-6, atol=1e-4)


def test_best_split_by_brute_force():
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((120, 3)), 1)
    x[rng.random((120, 3)) < 0.2] = np.nan
    y = rng.standard_normal(120) + np.nan_to_num(x[:, 1], nan=2.0)
    p = B.Params(trees=1, leaves=2, rate=1.0, rows=1.0, columns=1.0, least=10, l2=1.0)
    m = B.fit(x, y, p)
    r = y - m.base
    best = max((r[a].sum() ** 2 / (a.sum() + 1) + r[~a].sum() ** 2 / ((~a).sum() + 1)) for j in range(3) for e in m.edges[j] for nulls in (True, False) for a in [np.where(np.isnan(x[:, j]), nulls, x[:, j] <= e)] if 10 <= a.sum() <= 110)
    s = m.score(x) - m.base
    left = s == s[0]
    assert r[left].sum() ** 2 / (left.sum() + 1) + r[~left].sum() ** 2 / ((~left).sum() + 1) == pytest.approx(best)


def test_contributions_sum_to_scores_and_fit_ends_in_time():
    rng, x, f = noisy(1500)
    m = B.fit(x, f, B.Params(trees=20, rate=0.2))
    c = B.contributions(m, x)
    rest = m.score(x) - c.sum(1)
    assert np.allclose(rest, rest[0]) and np.abs(c).mean(0)[:2].min() > 5 * np.abs(c).mean(0)[2:].max()
    calls = []
    short = B.fit(x, f, B.Params(trees=50), watch=lambda model, tree: calls.append(1) or abs(len(calls) - 5), patience=4)
    assert len(calls) == 9 and len(short.trees) == 5


def panel(spark, months=60, seed=0):
    """Series with a season, a level and noise; goods of two chapters of six-digit codes."""
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(12):
        for c in range(5):
            level, phase = np.exp(rng.uniform(4, 7)), rng.integers(0, 12)
            for t in range(months):
                v = level * np.exp(0.8 * np.sin(2 * np.pi * (t + phase) / 12) + 0.1 * rng.standard_normal())
                rows.append(("x", 24000 + t, "bienes", f"{10 + p % 2}{p:04d}", str(c), float(v), 1.0, 1, 1, 1, False, str(10 + p % 2)))
    names = "period string, t int, segment string, product string, partner string, value double, quantity double, n_items long, n_decl long, n_firms long, pseudo boolean, chapter string"
    return spark.createDataFrame(rows, names)


def test_walk_forward_beats_the_moving_mean_on_seasonal_series(spark):
    g = X.grid(panel(spark)).cache()
    x = X.features(g, 1).cache()
    assert {r.chapter for r in x.select("chapter").distinct().collect()} == {"10", "11"}
    assert x.select("chapter", "t", "chapter_growth").distinct().count() == 2 * 60
    cfg = L.Config(trees=60, rate=0.1, least=20)
    pred = L.walk_forward(x, 1, [56, 57], cfg).join(X.baselines(g, 1).select("product", "partner", "t", "mean_3"), ["product", "partner", "t"]).toPandas()
    wape = lambda c: (pred[c] - pred["y"]).abs().sum() / pred["y"].sum()
    assert len(pred) == 120 and wape("model") < 0.5 * wape("mean_3")
    # later months changed: the forecasts of an origin stay as they are
    noisy_ = g.withColumn("v", F.when(F.col("i") > 56, F.rand(1) * 1e7).otherwise(F.col("v")))
    keys = ["product", "partner", "t"]
    a = L.walk_forward(x, 1, [56], cfg).select(*keys, "model").collect()
    b = L.walk_forward(X.features(noisy_, 1), 1, [56], cfg).select(*keys, "model").collect()
    assert sorted(a) == sorted(b) and a
    frozen = L.walk_forward(x, 1, [56, 57], cfg, False)
    assert {r.i for r in frozen.collect()} == {56, 57} and sorted(r.model for r in frozen.where("i = 56").collect()) == sorted(r.model for r in a)
    same = L.random_against_walk(x, 1, [55, 56, 57], cfg).collect()
    assert same and all(r.random is not None and r.walk is not None for r in same)
    status = R.monitor(pred_frame(spark, pred), ["model", "mean_3"], F.col("t") < 24057)
    assert {(r.method, r.months) for r in R.scenarios(status).collect()} == {("model", 2), ("mean_3", 2)}


def pred_frame(spark, pred):
    return spark.createDataFrame(pred[["t", "y", "model", "mean_3"]])


def test_training_rows_and_bounds(spark, monkeypatch):
    x = X.features(X.grid(panel(spark, 40)), 1).cache()
    assert L.training(x, 30, 1).agg({"i": "max"}).first()[0] == 29
    monkeypatch.setattr(L, "MOST_ROWS", 50)
    seen = L.fit_each(L.training(x, 38, 1), {0: L.Config(trees=2, least=5)}, L.NUMERIC, L.encode("delta"), F.array(F.lit(0)), ["product", "partner", "i"])
    assert set(seen) == {0}
    assert L.fit_each(x.where("false"), {0: L.Config()}, L.NUMERIC, L.encode("delta"), F.array(F.lit(0)), ["product"]) == {}
    none = L.walk_forward(x, 1, [11], L.Config(trees=2))
    assert all(r.model is None for r in none.collect())


def test_curves_and_rounds(spark):
    x = X.features(X.grid(panel(spark, 48)), 1)
    rows = S.chrono_split(L.training(x, 47, 1), "t", [0.5, 0.2, 0.3])
    cfg = L.Config(trees=40, rate=0.2, least=20)
    got = L.fit_evaluate(rows, "part", cfg, 5).collect()
    assert sum(r.best for r in got) == 1 and min(r.validation for r in got) == next(r.validation for r in got if r.best) and got[-1].train < got[0].train
    found = L.curves(rows, "part", L.sweep(cfg, [3, 15], [0.2, 1.0]), 5).collect()
    assert sorted((r.curve, r.share, r.leaves) for r in found) == [("complexity", 1.0, 3), ("complexity", 1.0, 15), ("learning", 0.2, 31), ("learning", 1.0, 31)]


def test_split_sizes(spark):
    rows = spark.range(1000).selectExpr("id", "cast(id % 13 as int) as m")
    got = {r.part: r["count"] for r in S.random_split(rows, ["id"], [0.5, 0.2, 0.3]).groupBy("part").count().collect()}
    assert got == {0: 500, 1: 200, 2: 300}
    parts = {r.m: r.part for r in S.chrono_split(rows, "m", [0.4, 0.2, 0.4]).select("m", "part").distinct().collect()}
    assert [parts[m] for m in range(13)] == [0] * 5 + [1] * 3 + [2] * 5


@pytest.mark.parametrize("n", [0, 1, 45, 85, 90])
def test_split_sizes_are_those_of_the_sql(spark, n):
    """Halves that doubles miss (45 * 0.7), and parts without rows."""
    from tradewinds.plans import catalog

    tail = catalog.ORACLE["spl02_random"].rsplit("select part::int as part", 1)[1]
    want = duckdb.sql(f"with n as (select {n}::bigint as n) select part::int as part{tail}").fetchall()
    got = S.sizes(S.random_split(spark.range(n), ["id"], [0.5, 0.2, 0.3]), 3)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and got.dtypes == [("part", "int"), ("n", "bigint")]
