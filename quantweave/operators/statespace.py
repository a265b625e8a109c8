"""Bayesian state-space volatility of bars: one chain a ticker, ticker by ticker in grouped maps.

    log r^2_t = time of day + slope of the time of day * v_{t-1} + x_t + e_t,  x_t = phi x_{t-1} + u_t

e_t, the log of a chi-square variable, is taken as a mixture of seven normals.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The published mixture for the log of a chi-square variable with one
# degree: weights, means and variances.
_SHARE = np.array([0.00730, 0.10556, 0.00002, 0.04395, 0.34001, 0.24566, 0.25750])
_MEAN = np.array([-11.40039, -5.24321, -9.83726, 1.50746, -0.65098, 0.52478, -2.35859])
_VARIANCE = np.array([5.79596, 2.61369, 5.17950, 0.16735, 0.64009, 0.34023, 1.26261])
MIX_MEAN = float(_SHARE @ _MEAN)
MIX_VARIANCE = float(_SHARE @ (_VARIANCE + _MEAN**2) - MIX_MEAN**2)


def design_rows(panel: DataFrame, sunday: int = 6) -> DataFrame:
    """v1, the volume deviation of the bar before, over session bounds (0 for the first), and
    `sunday_bar`, 1 to `sunday` for the bars after a Sunday's open, else 0. Time-of-day
    contrasts stay as `interval`: dense columns exist inside a fit only."""
    run = W.partitionBy("ticker").orderBy("ts")
    lag = F.when((F.dayofweek("ts") == 1) & (F.col("bar_idx") < sunday), F.col("bar_idx") + 1).otherwise(0)
    return panel.withColumns({"v1": F.coalesce(F.lag("vol_dev").over(run), F.lit(0.0)), "sunday_bar": lag.cast("int")})


def _matrix(df: pd.DataFrame, intervals: np.ndarray, sunday: int) -> np.ndarray:
    """Zero-sum time-of-day contrasts, lagged volume by time of day, Sunday bars and a constant."""
    own = df["interval"].to_numpy()[:, None] == intervals
    contrast = own[:, :-1].astype(float) - own[:, -1:]
    bars = df["sunday_bar"].to_numpy()[:, None] == np.arange(1, sunday + 1)
    return np.column_stack([np.ones(len(df)), contrast, own * df["v1"].to_numpy()[:, None], bars])


def _paths(y: np.ndarray, noise: np.ndarray, phi: float, u: float, rng) -> np.ndarray:
    """A draw of the states given y = x + e: filter forwards, draw backwards."""
    n = len(y)
    mean, cover = np.empty(n), np.empty(n)
    m, p = 0.0, u / max(1 - phi * phi, 1e-6)
    for t in range(n):
        if t:
            m, p = phi * m, phi * phi * p + u
        k = p / (p + noise[t])
        m, p = m + k * (y[t] - m), p * (1 - k)
        mean[t], cover[t] = m, p
    x, z = np.empty(n), rng.standard_normal(n)
    x[-1] = mean[-1] + np.sqrt(cover[-1]) * z[-1]
    for t in range(n - 2, -1, -1):
        k = cover[t] * phi / (phi * phi * cover[t] + u)
        x[t] = mean[t] + k * (x[t + 1] - phi * mean[t]) + np.sqrt(max(cover[t] * (1 - k * phi), 0)) * z[t]
    return x


def sample_chain(y: np.ndarray, design: np.ndarray, draws: int = 120, burn: int = 40, seed: int = 0) -> dict:
    """Posterior means of the coefficients, phi and the states' variance."""
    rng = np.random.default_rng(seed)
    n, size = design.shape
    beta = np.linalg.lstsq(design, y - MIX_MEAN, rcond=None)[0]
    x, phi, u = np.zeros(n), 0.9, 0.1
    kept = {"beta": np.zeros(size), "phi": 0.0, "u": 0.0}
    for turn in range(draws):
        rest = (y - design @ beta - x)[:, None] - _MEAN
        logs = np.log(_SHARE) - 0.5 * np.log(_VARIANCE) - 0.5 * rest * rest / _VARIANCE
        mass = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), axis=1)
        which = (mass < rng.random(n)[:, None] * mass[:, -1:]).sum(1)
        shift, noise = _MEAN[which], _VARIANCE[which]
        precision = (design / noise[:, None]).T @ design + 0.01 * np.eye(size)
        root = np.linalg.cholesky(precision)
        centre = np.linalg.solve(precision, design.T @ ((y - shift - x) / noise))
        beta = centre + np.linalg.solve(root.T, rng.standard_normal(size))
        x = _paths(y - shift - design @ beta, noise, phi, u, rng)
        before, after = x[:-1], x[1:]
        weight = before @ before / u + 1.0
        for _ in range(50):
            new = (before @ after / u + 0.9) / weight + rng.standard_normal() / np.sqrt(weight)
            if abs(new) < 1:
                phi = new
                break
        left = after - phi * before
        u = (0.05 + 0.5 * float(left @ left)) / rng.gamma(2.5 + len(left) / 2)
        if turn >= burn:
            kept["beta"] += beta / (draws - burn)
            kept["phi"] += phi / (draws - burn)
            kept["u"] += u / (draws - burn)
    return kept


def one_step(y: np.ndarray, fixed: np.ndarray, phi: float, u: float) -> np.ndarray:
    """Predictions of x_t from the bars before t, by the mixture's mean and variance."""
    out, m, p = np.zeros(len(y)), 0.0, u / max(1 - phi * phi, 1e-6)
    for t in range(len(y)):
        if t:
            m, p = phi * m, phi * phi * p + u
        out[t] = m
        k = p / (p + MIX_VARIANCE)
        m, p = m + k * (y[t] - fixed[t] - MIX_MEAN - m), p * (1 - k)
    return out


def volatility_chain(panel: DataFrame, train_end, draws: int = 120, burn: int = 40, sunday: int = 6, seed: int = 0) -> DataFrame:
    """(ticker, ts, fixed, x_t, h_pred, phi): fitted on trade dates up to `train_end`, predicted
    one bar ahead after it. A group is one ticker's bars, which grow with time only."""
    rows = design_rows(panel, sunday).select("ticker", "ts", "interval", "v1", "sunday_bar", "log_r2", (F.col("trade_date") <= F.lit(train_end)).alias("early"))

    def task(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("ts").reset_index(drop=True)
        early = df["early"].to_numpy(bool)
        intervals = np.unique(df["interval"].to_numpy()[early])
        if len(intervals) < 2 or early.all():
            return pd.DataFrame(columns=["ticker", "ts", "fixed", "x_t", "h_pred", "phi"])
        design, y = _matrix(df, intervals, sunday), df["log_r2"].to_numpy(float)
        found = sample_chain(y[early], design[early], draws, burn, seed)
        fixed = design @ found["beta"]
        x = one_step(y, fixed, found["phi"], found["u"])
        out = df.assign(fixed=fixed, x_t=x, h_pred=fixed + x, phi=found["phi"])
        return out.loc[~early, ["ticker", "ts", "fixed", "x_t", "h_pred", "phi"]]

    return rows.groupBy("ticker").applyInPandas(task, "ticker string, ts timestamp_ntz, fixed double, x_t double, h_pred double, phi double")
