"""Screening of hedge candidates: unit-root tests, baskets and Kalman hedge ratios of several assets."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The published response surface of the unit-root statistic with a
# constant (one series): bounds, the turn between both polynomials, and these.
_LEAST, _MOST, _TURN = -18.83, 2.74, -1.61
_BELOW = (2.1659, 1.4412, 0.038269)
_ABOVE = (1.7339, 0.93202, -0.12745, -0.010368)


def unit_root_probability(stat: float) -> float:
    if math.isnan(stat):
        return math.nan
    if stat > _MOST or stat < _LEAST:
        return float(stat > _MOST)
    z = sum(c * stat**i for i, c in enumerate(_BELOW if stat <= _TURN else _ABOVE))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, sum of squares and coefficient variances."""
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    rest = y - x @ beta
    squares = float(rest @ rest)
    scale = squares / max(len(y) - x.shape[1], 1)
    return beta, squares, scale * np.diag(np.linalg.pinv(x.T @ x))


def unit_root(y: np.ndarray, lags: int | None = None) -> tuple[float, float, int]:
    """(statistic, p-value, lags) of the augmented test with a constant; lags by the least
    information criterion over one common sample, unless given. Nulls are left out."""
    y = y[~np.isnan(y)]
    n = len(y)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2) if lags is None else lags
    if most < 0 or n < most + 4 or np.ptp(y) == 0:
        return math.nan, math.nan, 0
    step = np.diff(y)

    def design(k: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(first, len(step))
        return step[at], np.column_stack([y[at], *[step[at - i] for i in range(1, k + 1)], np.ones(len(at))])

    def criterion(k: int) -> float:
        target, x = design(k, most)
        squares = _ols(target, x)[1]
        return len(target) * math.log(max(squares, 1e-300) / len(target)) + 2 * x.shape[1]

    best = min(range(most + 1), key=criterion) if lags is None else lags
    target, x = design(best, best)
    beta, _, variance = _ols(target, x)
    stat = float(beta[0] / math.sqrt(variance[0])) if variance[0] > 0 else math.nan
    return stat, unit_root_probability(stat), best


def unit_root_by(series: DataFrame, value: str, keys: tuple[str, ...] = ("asset",), order: str = "t_idx", lags: int | None = None) -> DataFrame:
    """(keys, stat, p_value, lags), one series a key; its length is that of the calendar."""
    fields = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)

    def task(key, df):
        stat, p, k = unit_root(df.sort_values(order)[value].to_numpy(float), lags)
        return pd.DataFrame([[*key, stat, p, k]])

    return series.groupBy(*keys).applyInPandas(task, f"{fields}, stat double, p_value double, lags int")


def screen(panel: DataFrame, most: float = 0.05) -> DataFrame:
    """(asset, gamma, p_value, kept) of each candidate x of y: whether y - gamma x, gamma through the origin, reverts."""
    from .spreads import constant_spread

    spread = constant_spread(panel)
    gamma = spread.groupBy("asset").agg(F.first("gamma").alias("gamma"))
    tested = unit_root_by(spread.select("asset", "t_idx", "spread"), "spread")
    return gamma.join(tested, "asset").select("asset", "gamma", "p_value", F.coalesce(F.col("p_value") < most, F.lit(False)).alias("kept"))


def basket(panel: DataFrame, screened: DataFrame, most: float = 0.05) -> DataFrame:
    """(t_idx, gamma, spread, p_value, assets): y less gamma times the sum of the kept candidates;
    if that does not revert, of the one candidate that reverts most surely. Without a
    candidate there is no row. Periods in which one of them is missing are left out."""
    # a row an asset
    kept = screened.where("kept").select("asset", F.row_number().over(W.orderBy("p_value", "asset")).alias("place"), F.count("*").over(W.partitionBy(F.lit(0))).alias("many"))
    rows = panel.where("x is not null and y is not null").join(F.broadcast(kept), "asset")
    total = rows.groupBy("t_idx").agg(F.first("y").alias("y"), F.sum("x").alias("x"), F.count("*").alias("n"), F.first("many").alias("many"), F.max(F.when(F.col("place") == 1, F.col("x"))).alias("surest"))

    def task(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("t_idx")
        for own, x, assets in ((df[df["n"] == df["many"]], "x", None), (df[df["surest"].notna()], "surest", 1)):
            t, y, x = own["t_idx"].to_numpy(), own["y"].to_numpy(float), own[x].to_numpy(float)
            gamma = float(x @ y / (x @ x)) if x.any() else math.nan
            p = unit_root(y - gamma * x)[1]
            if assets or p < most:
                break
        return pd.DataFrame({"t_idx": t, "gamma": gamma, "spread": y - gamma * x, "p_value": p, "assets": assets or own["n"].to_numpy()})

    return total.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(task, "t_idx long, gamma double, spread double, p_value double, assets long")


def kalman_hedge(panel: DataFrame, assets: list[str], train_end: int, state_noise: float = 1e-4, noise: float = 1e-3) -> DataFrame:
    """(t_idx, spread, mu, gamma array) after `train_end`: y on several assets and a constant whose
    coefficients wander; they begin at the fit of the periods up to `train_end`.

    `panel` is (t_idx, asset, x, y); a period without one of the assets is left out. One
    series of the calendar's length is folded in one group."""
    wide = panel.groupBy("t_idx").pivot("asset", assets).agg(F.first("x")).join(panel.groupBy("t_idx").agg(F.first("y").alias("_y")), "t_idx").dropna()

    def task(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("t_idx")
        t, y = df["t_idx"].to_numpy(), df["_y"].to_numpy(float)
        x = np.column_stack([df[assets].to_numpy(float), np.ones(len(df))])
        early = t <= train_end
        state = np.linalg.lstsq(x[early], y[early], rcond=None)[0]
        wander = state_noise * np.eye(x.shape[1])
        cover = wander.copy()
        out = []
        for now, seen, row in zip(t[~early], y[~early], x[~early], strict=True):
            cover = cover + wander
            reach = cover @ row
            gain = reach / (row @ reach + noise)
            state = state + gain * (seen - row @ state)
            cover = cover - np.outer(gain, reach)
            out.append((int(now), float(seen - row @ state), float(state[-1]), state[:-1].tolist()))
        return pd.DataFrame(out, columns=["t_idx", "spread", "mu", "gamma"])

    return wide.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(task, "t_idx long, spread double, mu double, gamma array<double>")
