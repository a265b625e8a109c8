"""The bootstrap from moments against one that copies all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantweave.operators import refits, resampling


def _panel(periods=23, assets=7):
    rng = np.random.default_rng(5)
    n = periods * assets
    df = pd.DataFrame({"t_idx": np.repeat(np.arange(periods) * 3 + 10, assets), "asset": np.tile(np.arange(assets), periods), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    df["y"] = 0.3 * df["a"] - 0.1 * df["b"] + rng.normal(size=n)
    df.loc[[3, 40], "a"] = None
    df.loc[17, "y"] = None
    return df


@pytest.mark.parametrize("block", [4, 30])
def test_as_if_all_rows_were_copied(spark, block):
    pdf, warm = _panel(), 2 if block == 4 else 1
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    got = refits.bootstrap(df, "y", ["a", "b"], block, 5, warm, penalty=0.5).toPandas()
    whole = pdf.dropna()
    dates = np.sort(whole["t_idx"].unique())
    index = resampling.block_index(spark.range(len(dates)).withColumnRenamed("id", "t_idx"), block, 5).toPandas().sort_values("pos")
    want = {}
    for sample, rows in index.groupby("sample"):
        parts = [whole[whole["t_idx"] == dates[i]] for i in rows["t_idx"]]
        made = {"refit": [], "hold": [], "a": [], "b": []}
        for pos in range(warm * block, len(parts)):
            train = pd.concat(parts[: pos // block * block])
            x = np.column_stack([np.ones(len(train)), train["a"], train["b"]])
            c = np.linalg.solve(x.T @ x + np.diag([0, 0.5, 0.5]), x.T @ train["y"])
            c /= np.sqrt(np.mean((x @ c) ** 2))
            now = parts[pos]
            made["refit"].append(np.mean((c[0] + c[1] * now["a"] + c[2] * now["b"]) * now["y"]))
            made["hold"].append(now["y"].mean())
            for k in "ab":
                made[k].append((now[k] * now["y"]).mean())
        want |= {(sample, k): np.mean(v) / np.std(v, ddof=1) * 12**0.5 for k, v in made.items() if v}
    assert {(r.sample, r.strategy) for r in got.itertuples()} == set(want)
    for _, r in got.iterrows():
        assert r["sharpe"] == pytest.approx(want[r["sample"], r["strategy"]], rel=1e-8)
    assert bool(want) == (block == 4)


def test_empty_panel_singular_sums_and_names(spark):
    df = spark.createDataFrame(_panel()).replace(float("nan"), None)
    assert refits.bootstrap(df.where("false"), "y", ["a"], 4, 3, 1).count() == 0
    flat = refits.bootstrap(df.withColumn("b", F.lit(0.0)), "y", ["a", "b"], 4, 2, 1, penalty=0.0).toPandas()
    assert set(flat["strategy"]) == {"refit", "hold", "a", "b"}
    assert (flat[flat["strategy"].isin(["refit", "b"])]["sharpe"] == 0).all()
    with pytest.raises(ValueError):
        refits.bootstrap(df.withColumnRenamed("a", "hold"), "y", ["hold"])
