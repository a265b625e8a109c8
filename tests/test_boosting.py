"""Boosted trees against a search over all cuts, other layouts, and forests."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantweave import catalog
from quantweave.operators import boosting, classes

SF = Path("/root/testdata/sf0.001")


def _table(n, seed=3, kinds=10):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.clip(np.floor((x[:, 0] + 0.7 * x[:, 1] * x[:, 0] + 0.3 * rng.normal(size=n)) * 2 + kinds / 2), 0, kinds - 1).astype(int)
    return pd.DataFrame({"t": np.arange(n) // 20, "t_idx": np.arange(n) // 20, "asset": [f"a{i % 20}" for i in range(n)], "z1": x[:, 0], "z2": x[:, 1], "z3": x[:, 2], "cls": y})


def _loss(p, rows):
    both = p.toPandas().merge(rows, on=["t", "asset", "cls"])
    assert len(both) == len(rows)
    return -np.log(np.maximum(both["p"], 1e-15)).mean()


def test_one_level_is_the_best_of_all_cuts(spark):
    pdf, kinds = _table(300, kinds=4), 4
    pdf.loc[5, "z1"] = None
    names = ["z1", "z2", "z3"]
    model = boosting.fit(spark.createDataFrame(pdf), names, classes=kinds, rounds=1, depth=1, bins=8, sample=1.0, columns=1.0, held=0.0, rate=1.0)
    x = np.array([[np.sum(model.edges[i] < v) if v == v else 0 for v in pdf[c]] for i, c in enumerate(names)]).T
    counts = np.bincount(pdf["cls"], minlength=kinds) + 1
    p = counts / counts.sum()
    for k in range(kinds):
        g, h = p[k] - (pdf["cls"] == k).to_numpy(), np.full(len(pdf), p[k] * (1 - p[k]))
        best = (0.0, None)
        for f in range(3):
            for c in range(7):
                left = x[:, f] <= c
                if h[left].sum() < 1 or h[~left].sum() < 1:
                    continue
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
                if gain > best[0] + 1e-6:
                    best = (gain, (f, c, -g[left].sum() / (h[left].sum() + 1), -g[~left].sum() / (h[~left].sum() + 1)))
        f, c, low, high = best[1]
        assert (model.feature[0, k, 0], model.cut[0, k, 0]) == (f, c)
        assert model.value[0, k, 1:] == pytest.approx([low, high], abs=1e-3)


def test_layout_changes_no_tree(spark):
    df = spark.createDataFrame(_table(400))
    options = dict(rounds=2, depth=2, bins=16, runs=2, seed=7)
    a = boosting.fit(df.repartition(1), ["z1", "z2"], **options)
    b = boosting.fit(df.orderBy(F.rand(1)).repartition(5), ["z1", "z2"], **options)
    for x in ("feature", "cut", "value", "used", "losses"):
        assert np.array_equal(getattr(a, x), getattr(b, x))
    assert not np.array_equal(a.value[:, :10], a.value[:, 10:])  # runs differ


def test_loss_is_below_the_forests(spark):
    pdf = _table(2400)
    train, ask = pdf[pdf["t"] < 90], pdf[pdf["t"] >= 90]
    names = ["z1", "z2", "z3"]
    a, b = spark.createDataFrame(train), spark.createDataFrame(ask)
    model = boosting.fit(a, names, rounds=12, depth=3, bins=32, rate=0.3)
    p = boosting.probabilities(model, b)
    assert p.groupBy("t", "asset").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    ours, forests = _loss(p, ask), _loss(classes.ensemble_probabilities(a, b, names, models=2, trees=10, depth=4), ask)
    assert ours < forests
    assert model.losses[model.used[0], 0] == np.nanmin(model.losses) < model.losses[0, 0]


def test_a_start_sees_nothing_later(spark):
    pdf = _table(800)
    names = ["z1", "z2"]
    options = dict(rounds=2, depth=2, bins=8, gap=1)
    both = boosting.fit(spark.createDataFrame(pdf), names, starts=[20, 30], **options)
    pdf.loc[pdf["t_idx"] >= 19, ["z1", "cls"]] = [9.0, 0]
    other = boosting.fit(spark.createDataFrame(pdf), names, starts=[20, 30], **options)
    for x in ("feature", "cut", "value"):
        assert np.array_equal(getattr(both, x)[:, :10], getattr(other, x)[:, :10])
    assert not np.array_equal(both.value[:, 10:], other.value[:, 10:])
    asked = boosting.probabilities(both, spark.createDataFrame(pdf), every=5).select("t").distinct().orderBy("t").toPandas()["t"]
    assert asked.tolist() == [*range(20, 25), *range(30, 35)]


def test_empty_table_nulls_and_one_class(spark):
    df = spark.createDataFrame(_table(60))
    none = boosting.fit(df.where("false"), ["z1"], rounds=2)
    p = boosting.probabilities(none, df).toPandas()["p"]
    assert np.allclose(p, 0.1)
    assert boosting.probabilities(none, df.where("false")).count() == 0
    blank = df.withColumn("z1", F.lit(None).cast("double")).withColumn("cls", F.when(F.col("t") > 0, F.lit(3)))
    model = boosting.fit(blank, ["z1"], rounds=2, depth=2)
    got = boosting.probabilities(model, blank).groupBy("cls").agg(F.avg("p").alias("p")).orderBy(F.desc("p")).first()
    assert got["cls"] == 3
    with pytest.raises(ValueError):
        boosting.fit(df, [])


@pytest.mark.skipif(not SF.is_dir(), reason="the driver's tables are not here")
def test_query_trades_five_strategies_out_of_sample(spark):
    months = catalog.queries()["momentum_features"](spark, str(SF)).where("ret_fwd IS NOT NULL").select("t").distinct().orderBy("t").toPandas()["t"]
    got = catalog.queries()["boosted_class_strategies"](spark, str(SF)).toPandas()
    plain = catalog.queries()["class_strategies"](spark, str(SF)).where("strategy = 'momentum'").toPandas().set_index("t")["ls"]  # held against its SQL
    assert set(got["strategy"]) == {"momentum", "class", "dpr", "ret", "srp"}
    assert (got.groupby("strategy")["t"].nunique() == got["t"].nunique()).all()
    assert set(got["t"]) <= set(months) and got["t"].max() == months.max()
    momentum = got[got["strategy"] == "momentum"].set_index("t")["ls"]
    assert len(momentum) and np.allclose(momentum, plain[momentum.index], atol=1e-5)
    model_free = catalog.queries()["class_strategies"](spark, str(SF)).where("strategy = 'dpr'").toPandas().set_index("t")["ls"]
    dpr = got[got["strategy"] == "dpr"].set_index("t")["ls"]
    assert not np.allclose(dpr, model_free[dpr.index])
