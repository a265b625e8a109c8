"""The grid of graphs against graphs built a pair of parameters at a time."""

import numpy as np

from quantweave.operators import graphgrid


def test_every_pair_is_what_its_own_graph_earns(spark):
    rng = np.random.default_rng(4)
    names, alphas, betas, days = ["a", "b", "c", "d", "e"], [0.0, 0.3, 0.8], [0.0, 0.5], 25
    scores = {(w, i, j): float(rng.normal() / 2) for w in (1, 2) for i in names for j in names if i != j and "e" not in (i, j)}
    scores[1, "a", "e"] = scores[1, "e", "a"] = -1.0  # a node without edges
    rows = {(t, a): [*map(float, rng.normal(size=2)), float(rng.uniform(0.1, 1)), float(rng.normal())] for t in range(days) for a in names}
    got = graphgrid.search(
        spark.createDataFrame([(*k, v) for k, v in scores.items()], "win int, i string, j string, score double"),
        spark.createDataFrame([(*k, *v) for k, v in rows.items()], "t_idx long, asset string, x double, y double, sd double, r double"),
        alphas, betas, ["x", "y"], periods=50,
    ).collect()
    want = {}
    for a in alphas:
        for b in betas:
            w = np.zeros((5, 5))
            for win in (1, 2):
                v = np.array([[max(scores.get((win, i, j), 0.0), 0.0) for j in names] for i in names])
                w += np.maximum((v + v.T) / 2 - a / 2, 0) / (1 + b) / 2
            np.fill_diagonal(w, 1.0)
            w /= np.sqrt(np.outer(w.sum(1), w.sum(1)))
            profits = []
            for t in range(days - 2):
                x = w @ np.array([rows[t, n][:2] for n in names])
                position = (x * np.exp(-(x**2) / 4) / 0.89).mean(1) * 0.1 / (np.array([rows[t, n][2] for n in names]) * 50**0.5 + 1e-10) / 5
                profits.append(position @ np.array([rows[t + 2, n][3] for n in names]))
            want[a, b] = np.mean(profits) / np.std(profits, ddof=1) * 50**0.5
    assert {(r.alpha, r.beta) for r in got} == set(want)
    assert all(np.isclose(r.sharpe, want[r.alpha, r.beta]) and r.n == days - 2 for r in got)
    assert [(r.alpha, r.beta) for r in got if r.best] == [max(want, key=want.get)]


def test_too_few_periods_have_no_best(spark):
    scores = spark.createDataFrame([(1, "a", "b", 1.0)], "win int, i string, j string, score double")
    rows = spark.createDataFrame([(t, a, 1.0, 1.0, 0.1) for t in range(5) for a in "ab"], "t_idx long, asset string, x double, sd double, r double")
    got = graphgrid.search(scores, rows, [0.1], [1.0], ["x"]).collect()
    assert [(r.n, r.sharpe, r.best) for r in got] == [(3, None, False)]
