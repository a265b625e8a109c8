"""Network momentum against plain loops: schedule, versions, spreading, block-wise ridge."""

import numpy as np
import pytest

from quantweave.operators import momentum as M
from quantweave.operators import recursive as R


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(7)
    rows = []
    for a in range(7):
        for t in range(30):
            there = t >= a  # assets come in one after another
            rows.append((t, f"a{a}", float(rng.normal()), 0.5, float(rng.normal()), [float(x) for x in rng.normal(size=3)] if there else None))
    return spark.createDataFrame(rows, "t_idx long, asset string, r double, sd double, y double, u array<double>").cache()


def _rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_a_set_that_comes_back_has_its_last_graph(spark):
    sets = ["ab", "ab", "abc", "ab", "ab", "abc", "ab", None, "ab"]
    there = spark.createDataFrame([(t, x) for t, s in enumerate(sets) if s for x in s], "t_idx long, asset string")
    plan = M.schedule(there, 4)
    assert _rows(plan, "t_idx", "fit_idx") == [(0, 0), (1, 0), (2, 2), (3, 0), (4, 4), (5, 2), (6, 4), (8, 8)]
    held = M.versions(plan)
    assert _rows(held, "valid_from", "valid_to", "fit_idx") == [(0, 1, 0), (2, 2, 2), (3, 3, 0), (4, 4, 4), (5, 5, 2), (6, 6, 4), (8, 8, 8)]


def test_members_and_stacks_need_whole_windows(features):
    there = M.members(features, 4)
    data = {(r.t_idx, r.asset): r.u for r in features.collect()}
    names = sorted({a for _, a in data})
    whole = lambda t, a, w: t >= w and all(data[s, a] is not None for s in range(t - w, t))
    want = [(t, a) for t in range(30) for a in names if whole(t, a, 4) and sum(whole(t, b, 4) for b in names) >= 5]
    assert _rows(there, "t_idx", "asset") == want
    stacks = M.stacks(features, M.schedule(there, 5), 6)
    fits = {r.fit_idx for r in M.schedule(there, 5).collect()}
    assert _rows(stacks, "t", "asset", "v") == [(t, a, [x for s in range(t - 6, t) for x in data[s, a]]) for t in sorted(fits) for a in names if whole(t, a, 6)]


def test_neighbours_features_and_missing_ones(spark, features):
    there = spark.createDataFrame([(10, "a0"), (10, "a1"), (10, "a2"), (3, "a0")], "t_idx long, asset string")
    held = spark.createDataFrame([(9, 9, 12), (2, 2, 3)], "fit_idx long, valid_from long, valid_to long")
    edges = spark.createDataFrame([(9, "a0", "a1", 0.5), (9, "a0", "a2", 2.0), (9, "a1", "a0", 1.0), (2, "a0", "a5", 1.0)], "fit_idx long, i string, j string, w double")
    data = {(r.t_idx, r.asset): r.u for r in features.collect()}
    got = {(r.t_idx, r.asset): r.x for r in M.spread_over(features, there, held, edges, 3).collect()}
    assert np.allclose(got[10, "a0"], 0.5 * np.array(data[10, "a1"]) + 2 * np.array(data[10, "a2"]))
    assert np.allclose(got[10, "a1"], data[10, "a0"])
    assert got[10, "a2"] == [0.0] * 3  # no edge
    assert got[3, "a0"] is None  # its neighbour has no features yet


def test_block_sums_give_each_expanding_fit(features):
    rows = features.select("t_idx", "asset", "y", features.u.alias("x"))
    got = {r.period: r.coefs for r in M.block_ridge(rows, 3, 12, 5).collect()}
    data = [(r.t_idx, r.x, r.y) for r in rows.collect() if r.x is not None]
    for p in range(4):
        x = np.array([[*v, 1.0] for t, v, _ in data if t < 12 + 5 * p])
        y = np.array([z for t, _, z in data if t < 12 + 5 * p])
        want = np.linalg.solve(x.T @ x + 1e-4 * np.diag([1, 1, 1, 0]), x.T @ y)
        assert np.allclose(got[p], want)


def test_portfolio_scales_lags_and_counts(spark, features):
    positions = spark.createDataFrame([(t, "s", a, x) for t in (20, 21, 28) for a, x in (("a0", 1.0), ("a1", -1.0 if t == 20 else 1.0))], "t_idx long, strategy string, asset string, x double")
    got = {r.t_idx: r for r in M.portfolio(positions, features, 0.1, 4).collect()}
    r = {(x.t_idx, x.asset): x.r for x in features.collect()}
    scale = 0.1 / (0.5 * 2 + 1e-10)
    assert np.isclose(got[20].r, scale * (r[22, "a0"] - r[22, "a1"]) / 2)
    assert np.isclose(got[20].turnover, scale) and np.isclose(got[21].turnover, scale)
    assert 28 not in got  # its return is not there yet


@pytest.mark.parametrize("adjusted", [True, False])
def test_weighted_moments_are_those_of_the_weights(adjusted):
    rng = np.random.default_rng(1)
    x = 100 + rng.normal(size=40)
    x[[0, 5, 6, 20]] = np.nan
    mean, std = R.ew_moments(x, 0.2, adjusted, 2)
    for t in range(len(x)):
        w = []
        for i in range(t + 1):
            w = [v * 0.8 for v in w]
            if not np.isnan(x[i]):
                w.append(1.0 if adjusted or not w else 0.2)
                if not adjusted:
                    w = [v / sum(w) for v in w]
        v = x[: t + 1][~np.isnan(x[: t + 1])]
        if len(v) < 2:
            assert np.isnan(mean[t])
            continue
        w = np.array(w) / sum(w)
        m = w @ v
        assert np.isclose(mean[t], m)
        assert np.isclose(std[t], np.sqrt(w @ (v - m) ** 2 / (1 - w @ w)))
