"""Queries do the whole job: all months, all units, all partners."""

import numpy as np

from tradewinds.operators import causal, experiment
from tradewinds.plans import catalog, studies
from tradewinds.sources import raw

SF = "/root/testdata/sf0.001"


def test_event_study_has_every_month(spark, monkeypatch):
    monkeypatch.setattr(causal, "ppml", lambda rows, names: {"beta": np.zeros(len(names)), "var": np.eye(len(names))})  # the fit itself is slow
    rows = studies.sample(spark, SF)
    traded = {r.rel for r in rows.where("at_treated and group = 'taxed' and v > 0").select("rel").distinct().collect()}
    got = catalog.QUERIES["cau06_event_study"](spark, SF).collect()
    assert {r.rel for r in got} == traded | {-1}
    assert min(traded) < -12


def test_joint_wald_of_a_singular_variance():
    wald, df = causal.joint_wald(np.array([2.0, 2.0, 0.0]), np.array([[4.0, 4.0, 0.0], [4.0, 4.0, 0.0], [0.0, 0.0, 1.0]]))
    assert df == 2 and abs(wald - 1) < 1e-9


def test_replications_take_all_units_and_500_runs(spark, monkeypatch):
    seen = {}

    def taken(units, cluster, id_, lift, seeds):
        seen.update(units=units.count(), seeds=seeds)
        return units.limit(0)

    monkeypatch.setattr(experiment, "replications", taken)
    catalog.QUERIES["exp21_replications"](spark, SF)
    assert seen == {"units": studies.units(spark, SF).count(), "seeds": 500}


def test_placebos_are_all_partners_and_equal_did(spark, monkeypatch):
    rng = np.random.default_rng(1)
    data = [(f"p{p}", str(c), t, float(rng.poisson(20)), t - 8, "taxed") for p in range(4) for c in range(6) for t in range(12)]
    rows = spark.createDataFrame(data, "product string, partner string, t int, v double, rel int, `group` string").cache()
    got = {r.partner: r.beta for r in causal.placebos(rows, "5").collect()}
    assert set(got) == set("01234")
    one = causal.did(rows.where("partner <> '5'").selectExpr("*", "partner = '2' and rel >= 0 as treated")).first()
    assert abs(got["2"] - one.beta) < 1e-8
    seen = []
    monkeypatch.setattr(causal, "placebos", lambda rows, treated, n=30: seen.append(n) or rows.selectExpr("partner", "0D as beta"))
    monkeypatch.setattr(causal, "did", lambda rows: spark.createDataFrame([(0.0,)], "beta double"))
    catalog.QUERIES["cau07_placebos"](spark, SF)
    catalog.QUERIES["cau08_permutation"](spark, SF)
    assert seen == [30, 30]


def test_src17_reads_two_months_of_a_whole_store(spark, monkeypatch):
    seen, load = [], raw.load
    monkeypatch.setattr(raw, "load", lambda s, root, *a: seen.append(s.read.parquet(root).count()) or load(s, root, *a))
    got = catalog.QUERIES["src17_load"](spark, SF)
    assert seen == [spark.read.parquet(f"{SF}/orders.parquet").count()] and 0 < got.count() < seen[0]


def test_a_cluster_needs_a_shared_folder(spark):
    import pytest

    from tradewinds import shared

    class Session:
        def __init__(self, folder, master, checkpoint=None):
            self.conf = type("C", (), {"get": lambda _, key, default: folder})()
            self.sparkContext = type("S", (), {"master": master, "getCheckpointDir": lambda _: checkpoint})()

    assert shared.shared_dir(Session("s3://bucket/x/", "spark://host:1")) == "s3://bucket/x"
    assert shared.shared_dir(Session(None, "yarn", "hdfs://y")) == "hdfs://y"
    assert shared.shared_dir(Session(None, "local[8]"))
    for master in ("yarn", "spark://host:1", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            shared.shared_dir(Session(None, master))
    some = shared.empty_table(spark, "a long")
    shared.append(spark.range(3).toDF("a"), some)
    assert shared.reread(some).count() == 3
    shared.release(some)
