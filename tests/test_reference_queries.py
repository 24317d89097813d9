"""Each query with a SQL twin against DuckDB on the smallest tables, and fixtures worked by hand."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewinds.functions import scalars as S
from tradewinds.operators import causal, drift, experiment, features, graph, metrics, panel
from tradewinds.plans import catalog
from tradewinds.sources import raw

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(names)
    at = [list(names).index(n) for n in order]
    cell = lambda v: "null" if v is None or v != v else f"{float(v):.5f}" if isinstance(v, float) else str(v)
    return order, sorted([tuple(cell(r[k]) for k in at) for r in data])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in want.description]
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_entry_point_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


ITEM = "period string, t int, decl long, item int, item_value double, header_value double, qty double, product string, chapter string, partner string, trader long, segment string, pseudo boolean"


def item(decl, value, header, product="111111", partner="1", trader=1, t=24000):
    return ("2000-01", t, decl, 1, value, header, 1.0, product, "11", partner, trader, "bienes", False)


def test_imputation(spark):
    data = [item(1, 10.0, 30.0), item(1, None, 30.0), item(2, None, 9.0), item(2, None, 9.0), item(3, None, None), item(None, None, 5.0), item(4, -1.0, 1.0)]
    df = spark.createDataFrame(data, ITEM)
    report = panel.imputation_report(df).first()
    assert (report.null_items, report.imputed, report.imputed_value) == (5, 1, 20.0)
    cell = panel.panel(df).first()
    assert (cell.value, cell.n_items) == (29.0, 3)


def test_features_do_not_see_the_future(spark):
    rng = np.random.default_rng(0)
    data = [("x", 24000 + t, "bienes", f"Brand#{p}", str(c), float(rng.uniform(0, 100)), 1.0, 1, 1, 1, False, "k") for t in range(30) for p in range(3) for c in range(2) if rng.random() < 0.7 or t in (0, 29)]
    names = "period string, t int, segment string, product string, partner string, value double, quantity double, n_items long, n_decl long, n_firms long, pseudo boolean, chapter string"
    p = spark.createDataFrame(data, names)
    noisy = p.withColumns({c: F.when(F.col("t") > 24020, F.rand(1) * 1e7).otherwise(F.col(c)) for c in ("value", "quantity")})
    drop = ["target"]
    for h in (1, 2, 3):
        a, b = (sorted(map(str, features.features(features.grid(x), h, 2).where("t = 24020").drop(*drop).collect())) for x in (p, noisy))
        assert a == b and a


def test_proximity_by_hand(spark):
    fp = spark.createDataFrame([("a", 1, "p"), ("a", 1, "q"), ("a", 2, "p"), ("a", 2, "q"), ("a", 2, "r"), ("b", 1, "p")], "period string, trader long, product string")
    got = {(r.p, r.q): r.phi for r in graph.proximity(fp, 1).collect()}
    assert got == pytest.approx({("p", "q"): 1.5 / 3, ("p", "r"): 0.5 / 3, ("q", "r"): 0.5 / 2})
    with pytest.raises(ValueError):
        graph.proximity(fp, 1, "other")


def test_louvain_finds_cliques_and_backbone_spans(spark):
    e = [(f"{a}{i}", f"{a}{j}", 1.0) for a in "xy" for i in range(5) for j in range(i)] + [("x0", "y0", 0.1)]
    found = graph.louvain_of(e, 1.0, 42)
    assert len({found[f"x{i}"] for i in range(5)}) == 1 and found["x1"] != found["y1"]
    df = spark.createDataFrame(e, "p string, q string, phi double")
    assert graph.backbone(df, 1.0).where("phi < 1").count() == 1
    assert graph.communities(df).select("community").distinct().count() == 2
    assert graph.components(df).select("component").distinct().count() == 1


def test_psi_edges(spark):
    long = spark.createDataFrame([("c", 0, 1.0)] * 5 + [("c", 1, 1.0), ("c", 1, None)] + [("n", 0, float(x)) for x in range(100)] + [("n", 1, float(x)) for x in range(100)] + [("m", 0, float(x)) for x in range(100)] + [("m", 1, None)] * 50, "feature string, cur int, x double")
    got = {r.feature: r.psi for r in drift.psi(long, ["feature"]).collect()}
    assert got["c"] is None and got["n"] == pytest.approx(0) and got["m"] > 5


def test_control_chart_rules(spark):
    df = spark.createDataFrame([(1, -1.0), (2, 1.0), (3, -1.0), (4, 1.0), (5, 2.9), (6, 2.9), (7, -2.9), (8, 9.0)], "t int, x double")
    s = {r.t: r.status for r in drift.control_status(df, F.col("t") <= 4).collect()}
    assert [s[k] for k in (1, 5, 6, 7, 8)] == ["ok", "warn", "alert", "warn", "alert"]


def test_scores_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, p double")
    r = metrics.classification(df, "y", "p", []).first()
    assert r.auc == pytest.approx((0.5 + 1 + 0 + 1) / 4) and r.ap == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3, abs=1e-6)


def test_holm_textbook(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "arm string, p double")
    assert {r.arm: round(r.p_holm, 6) for r in experiment.holm(df).collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def units(spark, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(300):
        shock = rng.standard_normal()
        for _ in range(rng.integers(1, 20)):
            x = rng.standard_normal()
            score = 1 / (1 + math.exp(2 - 0.8 * x - 1.2 * shock))
            out.append((f"c{c}", float(score), float(x), float(rng.random() < score)))
    return spark.createDataFrame(out, "c string, score double, x double, y double")


def test_aa_rates_and_assignment(spark):
    u = units(spark).cache()
    rate = lambda clustered: experiment.aa_tests(u, "c", "y", 300, clustered).agg(F.avg((F.col("p") < 0.05).cast("double"))).first()[0]
    assert rate(False) > 0.10 and rate(True) < 0.09
    arms = experiment.assign(u, ["C", "A", "B"], [2, 1, 1], "c", "score").cache()
    assert arms.count() == 300 and abs(arms.where("arm = 'C'").count() / 300 - 0.5) < 0.02
    joined = experiment.cuped(u.join(arms, "c"), "y", ["score"])
    plain, less = (experiment.compare(joined, y, "c", "C").agg(F.max("se")).first()[0] for y in ("y", "y_adj"))
    assert less < plain


def test_closed_forms(spark):
    b = experiment.obf_bounds(4, sims=100_000)
    assert b[0] > b[-1] > 1.96
    assert experiment.mde(0.5, 2, 2) is None and 0 < experiment.mde(0.2, 5000, 5000) < 0.2
    n = experiment.sample_size(0.1, 0.2)["treatment"]
    assert 3700 < n < 4000
    assert experiment.dunnett([2.0], [0.5])[0] == pytest.approx(math.erfc(2 / math.sqrt(2)), abs=1e-6)
    assert experiment.dunnett([2.2, 1.0, 0.5], [0.5] * 3)[0] > math.erfc(2.2 / math.sqrt(2))
    assert experiment.omnibus([1.0, 1.0], [0.1, 0.1])["chi2"] == 0
    z = spark.createDataFrame([(0.0,), (1.0,), (3.5,)], "z double").select("z", experiment.two_sided(F.col("z")).alias("p")).collect()
    assert all(abs(r.p - math.erfc(r.z / math.sqrt(2))) < 2e-7 for r in z)


def test_ppml_recovers_effect(spark):
    rng = np.random.default_rng(7)
    out = []
    for p in range(60):
        month = rng.normal(0, 0.4, 19)
        for c in range(8):
            pair = rng.normal(0, 1.5)
            for t in range(19):
                mu = math.exp(pair + month[t] + (math.log(0.7) if c == 0 and t >= 15 else 0))
                out.append((f"p{p}", str(c), t, float(rng.poisson(2 * mu) / 2), c == 0 and t >= 15))
    f = causal.ppml(spark.createDataFrame(out, "product string, partner string, t int, v double, treated boolean"), ["treated"])
    assert abs(causal.effect(f["beta"][0]) + 0.3) < 0.08


def test_raw_files(spark, tmp_path):
    lines = ["1;a;x\"y;3;5;6", "2;b;spl", "it;4;5;6", "3;c", "4;d;1\r2;4;5;6", "5;1;2;3;4;5;6;7", "6;x", "7;y", "8", "9;1;2;3;4;5"]
    (tmp_path / "f.txt").write_bytes("\r\n".join(lines).encode("latin-1"))
    got = raw.read_lines(spark, str(tmp_path / "f.txt"), 6).collect()
    state = {r.line.split(";")[0]: (r.state, r.line) for r in got}
    assert state["2"] == ("joined", "2;b;split;4;5;6") and state["3"] == ("padded", "3;c;;;;") and state["5"][0] == "long"
    assert state["4"][1] == "4;d;1 2;4;5;6" and state["6"][0] == state["7"][0] == "padded" and state["1"][0] == "ok" and state["89"] == ("joined", "89;1;2;3;4;5")
    cells = spark.createDataFrame([("f", "00000000;1,5;\tx ", "ok"), ("f", "31022024;1.234,56;", "ok"), ("f", "29022024;nan;y", "ok"), ("f", "01012024;1.5d;z", "ok")], "file string, line string, state string")
    t = raw.typed(cells, ["d", "n", "s"], ["d"], ["n"])
    assert [(str(r.d), r.n, r.s) for r in t.collect()] == [("None", 1.5, "x"), ("None", None, None), ("2024-02-29", None, "y"), ("2024-01-01", None, "z")]
    log = raw.ingest_log(cells, t, "d", F.lit("2024-01")).first()
    assert (log.date_coerced, log.numeric_coerced, log.rows_outside_month) == (1, 3, 1)


def test_store_and_codes(spark, tmp_path):
    df = spark.createDataFrame([("exp", "2024-01", 1, 2), ("exp", "2024-02", 3, 4), ("imp", "2024-01", 5, 6)], "flow string, period string, a int, b int")
    raw.write_months(df, str(tmp_path / "s"))
    raw.write_months(df.where("period = '2024-02'").withColumn("a", F.lit(9)), str(tmp_path / "s"))
    assert sorted(r.a for r in raw.load(spark, str(tmp_path / "s"), "exp", ["a"]).collect()) == [1, 9]
    codes = spark.createDataFrame([(1, "First", "0056"), (2, "x", "n/a"), (3, "Other", "056"), (4, "Zero", "000"), (5, "Pseudo", "997")], "seq int, name string, code string")
    got = {r.code: (r.gloss, r.pseudo) for r in raw.code_table(codes, "name", "code", 900).collect()}
    assert got == {"56": ("First", False), "0": ("Zero", False), "997": ("Pseudo", True)}
    files = spark.createDataFrame([("a/Exportaciones_2024_03_parte2.zip",), ("a/readme.md",), ("b/importaciones-2025-11.rar",)], "path string")
    assert [(r.kind, r.year, r.month, r.part) for r in raw.list_resources(files).collect()] == [("exp", 2024, 3, 2), ("imp", 2025, 11, 1)]
    html = spark.createDataFrame([(1, "<p>Ports</p><table><tr><th>a<th>b</tr><tr><td>1</td><td> 2 </td></tr></table>"), (2, None)], "page_id long, html string")
    assert [(r.before, r.cells) for r in raw.html_tables(html).orderBy("row").collect()] == [("Ports", ["a", "b"]), ("Ports", ["1", "2"])]


def test_scalars(spark):
    df = spark.createDataFrame([("AB-1~salmon del atlantico congelado entero",), ("Vino tinto~x",), (None,)], "n string")
    assert [r[0] for r in df.select(S.description(F.col("n"))).collect()] == ["SALMON DEL ATLANTICO CONGELADO", "VINO TINTO", None]
    buckets = [r[0] for r in spark.range(1, 11).select(S.quantile_bucket(F.col("id"), F.lit(10), 4)).collect()]
    assert [buckets.count(k) for k in (1, 2, 3, 4)] == [3, 2, 2, 3]


def test_components_of_a_long_path_and_of_islands(spark):
    path = [(f"n{k:03d}", f"n{k + 1:03d}", 1.0) for k in range(200)]
    edges = spark.createDataFrame([*path, ("x", "y", 0.5)], "p string, q string, phi double")
    got = {r.product: r.component for r in graph.components(edges).collect()}
    assert {got[f"n{k:03d}"] for k in range(201)} == {"n000"} and got["x"] == got["y"] == "x"


def test_prefixes_and_chapters_of_customs_codes(spark):
    df = spark.createDataFrame([("01012990",), (None,), ("87",)], "code string")
    assert [tuple(r) for r in df.select(*S.prefixes(F.col("code"))).collect()] == [("010129", "01", "0101"), ("000000", "00", "0000"), ("87", "87", "87")]
    assert [r[0] for r in df.select(S.starts_with(F.col("code"), "01", "02")).collect()] == [True, False, False]


def test_trajectories_add_up(spark):
    panel_ = spark.createDataFrame([("p", "c", "1999-02", 5.0), ("p", "c", "1999-11", 2.0), ("p", "c", "1999-12", -9.0), ("p", "d", "1998-01", 1.0)], "product string, partner string, period string, value double")
    some = spark.createDataFrame([("p", "c", 7.0), ("p", "d", 1.0)], "product string, partner string, value_b double")
    got = {r.partner: r for r in experiment.trajectory(some, panel_, "1999").collect()}
    assert (got["c"].m01, got["c"].m02, got["c"].m10, got["c"].m12, got["c"].consistent) == (0.0, 5.0, 5.0, 7.0, True)
    assert (got["d"].m12, got["d"].consistent) == (0.0, False)


def test_entry_point_passes_over_an_absent_subpackage_only():
    import __spark_entry__ as e

    assert e._absent(ModuleNotFoundError(name="tradewinds.llm")) and not e._absent(ModuleNotFoundError(name="xxhash"))


def test_running_sums_in_ranges(spark, monkeypatch):
    from tradewinds.operators import ranks

    monkeypatch.setattr(ranks, "RANGES", 5)
    rng = np.random.default_rng(3)
    data = [(int(g), float(o) if o < 18 else None, k, int(v)) for k, (g, o, v) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 20, 200), rng.integers(0, 9, 200)))]
    df = spark.createDataFrame(data, "g int, o double, k int, v int")
    got = {r.k: r for r in ranks.running(df, ["g"], F.col("o"), {"n": F.lit(1), "s": F.col("v")}, ("k",)).collect()}
    for g in range(3):
        own = sorted((x for x in data if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        for n, x in enumerate(own, 1):
            assert (got[x[2]].n, got[x[2]].s, got[x[2]].all_n) == (n, sum(y[3] for y in own[:n]), len(own))


def test_tables_are_found_by_title_and_header(spark):
    html = "<p>Countries</p><table><tr><th>Name</th><th>Code</th></tr><tr><td>A</td><td>1</td></tr></table><h2>Ports</h2><table><tr><td>x</td></tr></table><h2>ports of call</h2><table><tr><th>PORT code</th></tr><tr><td>7</td><tr><td>8</table>"
    tables = raw.html_tables(spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "page_id long, html string"))
    assert [(r.page_id, r.table, r.cells) for r in raw.find_table(tables, "Ports", "port").orderBy("row").collect()] == [(1, 2, ["7"]), (1, 2, ["8"])]
    assert [r.cells for r in raw.find_table(tables, "countries", "CODE").collect()] == [["A", "1"]]
