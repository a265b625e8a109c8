"""Hedges, spread periods and threshold sweeps against loops over rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantweave.operators import hedges, recursive, spreadperiods, statemaps


@pytest.fixture(scope="module")
def legs(spark):
    rng = np.random.default_rng(3)
    rows = [(a, t, *(float(x) for x in 5 + rng.normal(size=4))) for a in ("p", "q") for t in range(40)]
    rows = [(a, t, None if (a, t) == ("p", 11) else y, b, None if (a, t) == ("q", 20) else c, d) for a, t, y, b, c, d in rows]
    return spark.createDataFrame(rows, "asset string, t_idx long, y double, b double, c double, d double").cache()


def _data(df):
    return {a: sorted((r.t_idx, r.y, r.b, r.c, r.d) for r in df.collect() if r.asset == a) for a in ("p", "q")}


def _slopes(rows):
    return np.linalg.lstsq(np.array([r[2:] for r in rows]), np.array([r[1] for r in rows]), rcond=None)[0]


def test_rolling_hedges_are_least_squares_on_the_rows_before(legs):
    got = {(r.asset, r.t_idx): r for r in hedges.rolling_hedge(legs, "y", ["b", "c", "d"], 10).collect()}
    for a, rows in _data(legs).items():
        for i, row in enumerate(rows):
            before, r = rows[max(0, i - 10) : i], got[a, row[0]]
            if len(before) < 10 or any(None in x for x in before):
                assert not r.fitted and r.gamma_b is None
                continue
            want = _slopes(before)
            assert r.fitted and np.allclose([r.gamma_b, r.gamma_c, r.gamma_d], want)
            assert r.spread is None if None in row else np.isclose(r.spread, row[1] - np.dot(want, row[2:]))


def test_constant_hedges_fit_the_rows_that_are_asked_for(legs):
    got = hedges.constant_hedge(legs, "y", ["b", "c"], F.col("t_idx") < 25).collect()
    for a, rows in _data(legs).items():
        want = _slopes([r[:4] for r in rows if r[0] < 25 and None not in r[:4]])
        assert all(np.allclose([r.gamma_b, r.gamma_c], want) for r in got if r.asset == a)


def test_dependent_regressors_have_no_hedge(legs):
    twice = legs.withColumn("c", F.col("b") * 2)
    assert {r.gamma_b for r in hedges.constant_hedge(twice, "y", ["b", "c"]).collect()} == {None}


def test_rows_go_to_the_periods_that_own_or_warm_up_with_them(spark):
    rows = spark.createDataFrame([("a", t) for t in range(43)], "asset string, t_idx long")
    got = sorted((r.period, r.t_idx, r.own) for r in spreadperiods.with_halo(rows, 20, 10, 7).collect())
    assert got == [(k, t, t >= 20 + 10 * k) for k in range(4) for t in range(max(0, 13 + 10 * k), min(43, 30 + 10 * k))]
    assert sorted(t for k, t, own in got if own) == list(range(20, 43))
    assert spreadperiods.with_halo(rows.limit(0), 20, 10, 7).count() == 0


def test_period_spreads_are_those_of_each_period_alone(spark):
    rng = np.random.default_rng(5)
    x = 4 + np.cumsum(rng.normal(size=60)) / 20
    y = 1.3 * x + rng.normal(size=60) / 10
    there = rng.random(60) > 0.1
    panel = spark.createDataFrame([("a", t, float(y[t]) if there[t] else None, float(x[t])) for t in range(60)], "asset string, t_idx long, y double, x double")
    got = {(r.kind, r.period, r.t_idx): r for r in spreadperiods.spreads(panel, 20, 10, 8, 5, 1e-3, 1e-2).collect()}
    want = {}
    for k in range(5):
        a = 20 + 10 * k
        ins = [t for t in range(a - 20, a) if there[t]]
        ext = [t for t in range(a - 8, min(a + 10, 60)) if there[t]]
        if not ext:
            continue
        gamma = x[ins] @ y[ins] / (x[ins] @ x[ins])
        state = np.linalg.lstsq(np.array([[x[t], 1.0] for t in ins]), y[ins], rcond=None)[0]
        cov = np.eye(2) * 1e-3
        for i, t in enumerate(ext):
            want["constant", k, t] = y[t] - gamma * x[t]
            if i >= 5:
                w = ext[i - 5 : i]
                want["rolling", k, t] = y[t] - x[w] @ y[w] / (x[w] @ x[w]) * x[t]
            cov = cov + np.eye(2) * 1e-3
            h = np.array([x[t], 1.0])
            s = h @ cov @ h + 1e-2
            g = cov @ h / s
            state = state + g * (y[t] - h @ state)
            cov = cov - np.outer(g, g) * s
            want["kalman", k, t] = y[t] - h @ state
    assert got.keys() == want.keys()
    assert all(np.isclose(got[k].spread, v) and got[k].own == (k[2] >= 20 + 10 * k[1]) for k, v in want.items())


@pytest.mark.parametrize("block", [3, 16, 4096])
def test_one_pass_gives_what_each_pair_gives_alone(spark, block):
    rng = np.random.default_rng(9)
    pairs = [(1.0, 0.5), (0.5, 0.0), (2.0, 1.0), (1.5, -0.25)]
    rows = []
    for s in ("a", "b"):
        for p in range(3):
            for t in range(p * 20, p * 20 + 31):  # restarts overlap, as warm-ups do
                z = float(rng.normal() * 1.5)
                rows.append((s, p, t, None if rng.random() < 0.1 else z, t >= p * 20 + 11, float(rng.normal() / 50) if rng.random() < 0.9 else None))
    frame = spark.createDataFrame(rows, "k string, run int, t_idx long, z double, own boolean, g double")
    got = {(r.k, r.enter, r.leave): r for r in statemaps.sweep(frame, {"z": pairs}, ["k"], "run", "own", "g", block).collect()}
    assert len(got) == 8
    for s in ("a", "b"):
        for enter, leave in pairs:
            position, profit = [], []
            for p in range(3):
                own = sorted(r[2:] for r in rows if r[:2] == (s, p))
                states = recursive.threshold_state(np.array([np.nan if r[1] is None else r[1] for r in own]), enter, leave)
                position += [x for x, r in zip(states, own, strict=True) if r[2]]
                profit += [x * (r[3] or 0.0) for x, r in zip(states, own, strict=True) if r[2]]
            run = np.cumsum(profit)
            r = got[s, enter, leave]
            assert (r.n, r.on, r.moved) == (len(position), np.count_nonzero(position), np.count_nonzero(np.diff(position)))
            assert np.allclose([r.total, r.square, r.dip], [run[-1], np.dot(profit, profit), (run - np.maximum.accumulate(run)).min()])


def test_sweep_of_nothing(spark):
    frame = spark.createDataFrame([], "k string, run int, t_idx long, z double, own boolean, g double")
    assert statemaps.sweep(frame, {"z": [(1.0, 0.5)]}, ["k"], "run", "own", "g").count() == 0


def test_metrics_of_a_record(spark):
    profit = np.array([0.01, -0.02, 0.03, 0.0, -0.05, 0.02])
    run = np.cumsum(profit)
    dip = float((run - np.maximum.accumulate(run)).min())
    row = [("z", 1.0, 0.5, 6, float(run[-1]), float(profit @ profit), 5, 2, dip), ("z", 2.0, 0.5, 6, 0.0, 0.0, 0, 0, 0.0)]
    flat, r = sorted(statemaps.metrics(spark.createDataFrame(row, "score string, enter double, leave double, n long, total double, square double, on long, moved long, dip double"), 12).collect(), key=lambda x: -x.enter)
    assert flat.sharpe is None and flat.calmar is None
    assert np.isclose(r.sharpe, profit.mean() / profit.std(ddof=1) * 12**0.5)
    assert np.isclose(r.calmar, np.expm1(run[-1] / 0.5) / abs(np.expm1(dip)))
    assert (r.on_share, r.trades) == (5 / 6, 2)
