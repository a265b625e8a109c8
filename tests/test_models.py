"""Operators without SQL against brute force or enumeration."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantweave.operators import barrier, classes, resampling, screening, statespace, timewarp, walkforward
from quantweave.operators import performance as P
from quantweave.sources import files, synthetic
from quantweave.streaming import bars as stream


def _warp(x, y):
    n, m = len(x), len(y)
    d = {(0, 0): 0.0}
    for i, j in itertools.product(range(n + 1), range(m + 1)):
        if i and j:
            d[i, j] = ((x[i - 1] - y[j - 1]) ** 2).sum() + min(d.get(k, math.inf) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
    steps, i, j = [], n, m
    while i and j:
        steps.append(j - i)
        i, j = min(((i - 1, j), (i, j - 1), (i - 1, j - 1)), key=lambda k: d.get(k, math.inf))
    return min(set(steps), key=lambda s: (-steps.count(s), s))


@pytest.mark.parametrize("seed", range(6))
def test_warped_lags_are_brute_force(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.standard_normal((7, 9, 2)), rng.standard_normal((7, 6 + seed, 2))
    assert timewarp.warp_lags(x, y).tolist() == [_warp(a, b) for a, b in zip(x, y, strict=True)]


def test_a_leader_has_a_positive_lag(spark):
    rng = np.random.default_rng(3)
    base = np.convolve(rng.standard_normal(80), np.ones(4) / 4, "valid")
    data = [(0, t, a, float(base[t + 5 - k])) for a, k in (("leads", 0), ("lags", 3)) for t in range(60)] + [(0, 0, "short", 1.0)]
    df = spark.createDataFrame(data, "win int, t_idx int, asset string, v double")
    for method in ("dtw", "ddtw", "sdtw", "sddtw"):
        got = {(r.i, r.j): r.lag for r in timewarp.lag_matrix(df, method).collect()}
        assert got == {("leads", "lags"): 3, ("lags", "leads"): -3}, method


def test_wilcoxon_and_ks_tails_are_enumerated():
    for n in (1, 4, 7):
        sums = [sum(k for k, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 2 + 1):
            assert resampling.wilcoxon_tail(w, n, 0) == pytest.approx(np.mean([s >= w for s in sums]))
    for h in range(1, 6):
        reached = [max(np.cumsum([1 if k in up else -1 for k in range(10)])) >= h for up in itertools.combinations(range(10), 5)]
        assert resampling.ks_tail(h / 5, 5, 5) == pytest.approx(np.mean(reached))


def test_t_probabilities(spark):
    known = [(2.228139, 10, 0.05), (12.706205, 1, 0.05), (4.302653, 2, 0.05), (3.182446, 3, 0.05), (1.959964, 100000, 0.05), (0.0, 5, 1.0)]
    df = spark.createDataFrame([(t, n) for t, n, _ in known], "t double, n long")
    for (_, _, p), r in zip(known, df.select(P.t_probability(F.col("t"), F.col("n")).alias("p")).collect(), strict=True):
        assert r.p == pytest.approx(p, abs=2e-5)


def test_ruin_ends_a_series(spark):
    df = spark.createDataFrame([("a", t, r, 1.0) for t, r in enumerate([0.1, -1.2, 0.5])] + [("b", t, 0.1, 1.0) for t in range(3)], "strategy string, t int, r double, turnover double")
    got = {r.strategy: r for r in P.summary(df, 12, kind="geometric").collect()}
    assert got["a"].ann_ret == -1 and got["a"].max_dd == -1
    assert got["b"].ann_ret == pytest.approx(1.1**12 - 1)
    cost = {r.strategy: r.breakeven_bps for r in P.breakeven_cost(df, 12, 2000).collect()}
    assert cost == {"a": 0, "b": 1000}


def test_unit_root():
    rng = np.random.default_rng(1)
    walk, noise = np.cumsum(rng.standard_normal(300)), rng.standard_normal(300)
    assert screening.unit_root(walk)[1] > 0.05 > screening.unit_root(noise)[1]
    # points of the published table of the statistic with a constant
    for p, value in ((0.01, -3.43), (0.05, -2.86), (0.10, -2.57)):
        assert screening.unit_root_probability(value) == pytest.approx(p, rel=0.06)
    assert math.isnan(screening.unit_root(np.ones(50))[0])


def test_basket_and_kalman(spark):
    rng = np.random.default_rng(2)
    a, b = (50 + np.cumsum(rng.standard_normal(200)) for _ in range(2))
    far = 50 + np.cumsum(rng.standard_normal(200))
    y = 0.5 * (a + b) + 0.1 * rng.standard_normal(200)
    data = [(t, n, float(x[t]), float(y[t])) for t in range(200) for n, x in (("a", a), ("b", b), ("far", far))]
    df = spark.createDataFrame(data, "t_idx long, asset string, x double, y double")
    kept = spark.createDataFrame([("a", 0.2, True), ("b", 0.1, True), ("far", 0.9, False)], "asset string, p_value double, kept boolean")
    got = screening.basket(df, kept).collect()
    assert len(got) == 200 and {r.assets for r in got} == {2}
    assert got[0].gamma == pytest.approx(0.5, abs=0.01) and got[0].p_value < 0.01
    fits = screening.kalman_hedge(df, ["a", "b"], 100).orderBy("t_idx").collect()
    assert len(fits) == 99
    assert fits[-1].gamma == pytest.approx([0.5, 0.5], abs=0.1)


def test_barrier_graph_meets_its_conditions():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((9, 6))
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    for alpha, beta in ((1.0, 0.5), (0.1, 2.0)):
        w = barrier.barrier_graph(d, alpha, beta)
        i, j = np.triu_indices(9, 1)
        slope = d[i, j] - alpha * (1 / w.sum(1)[i] + 1 / w.sum(1)[j]) + 4 * beta * w[i, j]
        on = w[i, j] > 1e-6
        assert np.abs(slope[on]).max() < 1e-3 and (slope[~on] > -1e-3).all()
        assert (w == w.T).all() and not w.diagonal().any()


def test_forests_average_to_probabilities(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 2))
    rows = [(k, f"a{k}", float(p), float(q), int(p > 0) * 2) for k, (p, q) in enumerate(x)]
    df = spark.createDataFrame(rows, "t int, asset string, z1 double, z2 double, cls int")
    got = classes.ensemble_probabilities(df, df, ["z1", "z2"], classes=4, models=2, trees=5, depth=3)
    sums = got.groupBy("t", "asset").agg(F.sum("p").alias("s"), F.max_by("cls", "p").alias("cls"), F.count("*").alias("n")).join(df.select("t", F.col("cls").alias("true")), "t").collect()
    assert all(r.s == pytest.approx(1) and r.n == 4 for r in sums)
    assert np.mean([r.cls == r.true for r in sums]) > 0.95


def test_chain_finds_the_persistence():
    rng = np.random.default_rng(7)
    x = np.zeros(2500)
    for t in range(1, len(x)):
        x[t] = 0.9 * x[t - 1] + 0.5 * rng.standard_normal()
    y = -3 + x + np.log(rng.standard_normal(len(x)) ** 2)
    found = statespace.sample_chain(y, np.ones((len(y), 1)), 150, 50)
    assert found["phi"] == pytest.approx(0.9, abs=0.06)
    assert found["beta"][0] == pytest.approx(-3, abs=0.5)
    ahead = statespace.one_step(y, np.full(len(y), found["beta"][0]), found["phi"], found["u"])
    assert np.corrcoef(ahead, x)[0, 1] > 0.6
    # the mixture has the moments of the log of a chi-square variable
    assert statespace.MIX_MEAN == pytest.approx(-1.2704, abs=0.01)
    assert statespace.MIX_VARIANCE == pytest.approx(math.pi**2 / 2, abs=0.02)


def test_ridge_is_the_normal_equations(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((50, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.3 + 0.1 * rng.standard_normal(50)
    df = spark.createDataFrame([(k % 2, *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y, strict=True))], "period int, a double, b double, c double, y double")
    got = {(r.period, r.term): r.coef for r in walkforward.ridge(df, "y", ["a", "b", "c"], 2.0).collect()}
    for p in (0, 1):
        one = np.column_stack([np.ones(25), x[p::2]])
        want = np.linalg.solve(one.T @ one + np.diag([0, 2.0, 2.0, 2.0]), one.T @ y[p::2])
        assert [got[p, t] for t in ("const", "a", "b", "c")] == pytest.approx(want.tolist())


def test_csv_tables(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("date,A,B C\n2024-01-01,0.1,x\nnone,1,1\n2024-01-02,,inf\n")
    got = sorted((str(r.t), r.asset, r.r) for r in files.wide(spark, str(tmp_path / "wide.csv")).collect())
    assert got == [("2024-01-01", "A", 0.1), ("2024-01-01", "B C", None), ("2024-01-02", "A", None), ("2024-01-02", "B C", None)]
    (tmp_path / "market.csv").write_text("date,ret\n2024-01-01,0.5\n")
    assert [tuple(r) for r in files.market(spark, str(tmp_path / "market.csv")).select("r").collect()] == [(0.5,)]
    with pytest.raises(ValueError):
        files.market(spark, str(tmp_path / "wide.csv"))
    (tmp_path / "empty.csv").write_text("date,A\n")
    with pytest.raises(ValueError):
        files.wide(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "chars.csv").write_text("date,ticker,market_cap,turnover,more\n2024-01-01,A,5,0.1,z\n,B,1,1,z\n")
    assert [(r.asset, r.market_cap) for r in files.characteristics(spark, str(tmp_path / "chars.csv")).collect()] == [("A", 5.0)]
    files.write_table(spark.range(3), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3
    gaps = spark.createDataFrame([("A", 0, None), ("A", 1, 2.0), ("A", 2, None), ("B", 0, None), ("B", 1, None), ("B", 2, None)], "asset string, t_idx int, price double").withColumn("t", F.col("t_idx"))
    assert {r.t_idx for r in files.clean_prices(gaps, drop_empty=True).collect()} == {1, 2}


def test_synthetic_panels(spark):
    a = synthetic.weekly_panel(spark, 120, 6)
    assert a.count() == 720
    fit = a.agg(F.regr_slope("r", "q").alias("b")).first().b
    assert fit == pytest.approx(0.4, abs=0.1)
    m = synthetic.lead_lag_market(spark, 300, 20, 4)
    assert m.count() == 6000 and m.where("leader").select("asset").distinct().count() == 4
    again = synthetic.lead_lag_market(spark.newSession(), 300, 20, 4)
    assert m.agg(F.sum("r")).first()[0] == again.agg(F.sum("r")).first()[0]


def _streamed(spark, tmp_path, df, make, name):
    path = str(tmp_path / "in")
    for k in range(3):
        df.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streamed_bars_are_batch_bars(spark, tmp_path):
    rng = np.random.default_rng(9)
    ticks = [(f"k{t % 2}", 60 * t, float(v), t // 40) for t, v in enumerate(rng.standard_normal(120))]
    df = spark.createDataFrame(ticks, "ticker string, s long, value double, part int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = {tuple(r) for r in _streamed(spark, tmp_path, df, stream.bars, "streamed_bars").collect()}
    want = {tuple(r) for r in stream.bars(df).collect()}
    assert got <= want
    # what the watermark has passed is there: all but the last minutes
    assert len(got) >= len(want) - 2 * 3


def test_streamed_recursions_are_batch_ones(spark, tmp_path):
    from quantweave.operators import recursive as R

    rng = np.random.default_rng(10)
    z = rng.standard_normal(90)
    df = spark.createDataFrame([("k", t, float(v), t // 30) for t, v in enumerate(z)], "ticker string, ts long, value double, part int")
    cases = {"ewma": (stream.ewma(0.3), R.ewma(z, 0.3)), "garch": (stream.garch(1e-3, 0.1, 0.8, 0.5), R.garch(z, 1e-3, 0.1, 0.8, 0.5)), "states": (stream.thresholds(1.0, 0.25), R.threshold_state(z, 1.0, 0.25))}
    for name, (step, want) in cases.items():
        (tmp_path / name).mkdir()
        got = _streamed(spark, tmp_path / name, df, lambda rows, step=step: stream.recursion(rows, step), f"streamed_{name}").orderBy("ts").collect()
        assert [r.result for r in got] == pytest.approx(want.tolist())


def test_class_walk_forward_leaves_the_sales_after_one_pass(spark):
    from pathlib import Path

    from quantweave import catalog

    sf = Path("/root/testdata/sf0.001")
    if not sf.is_dir():
        pytest.skip("the driver's tables are not here")
    made = catalog.queries()["class_walk_forward"](spark, str(sf))
    assert "l_shipdate" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.count() > 0
